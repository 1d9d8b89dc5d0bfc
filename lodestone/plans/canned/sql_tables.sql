-- The tables that an object touches.
-- :object TEXT
-- @entity table_name table
-- @entity proc_name procedure
SELECT table_name, source, operation, proc_name, $object AS object, line FROM all_sql_tables WHERE object = $object ORDER BY source, table_name, proc_name, line
