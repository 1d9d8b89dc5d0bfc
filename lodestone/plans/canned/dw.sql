-- Which columns of which tables a report retrieves.
-- :name TEXT
-- @entity table_name table
SELECT table_name, array_join(array_sort(collect_set(column_name)), ', ') AS columns
FROM dw_retrieve_columns
WHERE object = $name
GROUP BY table_name
