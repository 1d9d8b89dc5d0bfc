-- Everything that touches a table.
-- :table_name TEXT
-- @entity object object
SELECT object, proc_name, operation, source FROM all_sql_tables WHERE table_name = $table_name ORDER BY operation, object, proc_name
