-- Reports that no call names and no table reference has.
SELECT o.object AS datawindow, o.file FROM dw_objects o LEFT ANTI JOIN call_sites c ON lower(c.to_name) = lower(o.object)
LEFT ANTI JOIN all_sql_tables a ON lower(a.table_name) = lower(o.object) ORDER BY datawindow, file
