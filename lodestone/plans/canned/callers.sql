-- The procedures that call a name, one row per way of calling.
-- :name TEXT
-- @entity caller object
WITH hits AS (SELECT object, proc_name, call_type, count(*) AS n FROM call_sites WHERE to_name = $name GROUP BY object, proc_name, call_type)
SELECT object AS caller, proc_name, call_type FROM hits ORDER BY caller, proc_name, call_type
