-- Tables that reports retrieve, by the number of reports.
-- @entity table_name table
SELECT table_name, count(DISTINCT object) AS datawindow_count, array_join(array_sort(collect_set(object)), ', ') AS datawindows
FROM dw_retrieve_tables GROUP BY table_name ORDER BY datawindow_count DESC, table_name
