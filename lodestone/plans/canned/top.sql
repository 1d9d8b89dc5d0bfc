-- Procedures by complexity, the highest first and unknown ones last.
-- :n INT 15
-- @entity object object
WITH ranked AS (SELECT *, coalesce(cyclomatic, -1) AS weight FROM procedures)
SELECT object, proc_name AS name, proc_type, cyclomatic FROM ranked ORDER BY weight DESC, object, name, proc_type LIMIT $n
