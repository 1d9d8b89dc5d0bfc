-- How many statements could not be read, forms without structure aside.
SELECT count(*) AS n FROM sql_statements WHERE NOT parse_ok AND operation NOT IN ('CONNECT', 'DISCONNECT', 'EXECUTE', 'OPEN', 'FETCH', 'CLOSE')
AND NOT (operation = 'DECLARE' AND regexp_like(raw_sql, '(?i)DYNAMIC\\s+CURSOR\\s+FOR\\s+\\w+\\s*;?\\s*$')) AND NOT (operation = 'DECLARE' AND regexp_like(raw_sql, '(?i)\\w+\\s+PROCEDURE\\s+FOR\\s+\\w+'))
