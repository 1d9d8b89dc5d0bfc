-- What the lint finds in embedded statements, warnings first.
SELECT issue_code, severity, object, proc_name, line, raw_sql
FROM sql_lint_issues
ORDER BY CASE severity WHEN 'warning' THEN 0 ELSE 1 END, object, proc_name, line, issue_code
