-- Objects that many call and whose procedures are complex, the worst first.
-- :min_degree INT 5
-- :min_cyclomatic INT 3
-- @entity object object
WITH bodies AS (
  SELECT object, max(cyclomatic) AS worst, avg(cyclomatic) AS mean, count(proc_name) AS n FROM procedures GROUP BY object
), called AS (
  SELECT object, in_degree FROM call_degrees WHERE in_degree >= $min_degree
)
SELECT object, in_degree, worst AS max_cyclomatic, mean AS avg_cyclomatic, n AS proc_count
FROM called JOIN bodies USING (object)
WHERE worst >= $min_cyclomatic
ORDER BY in_degree * worst DESC, object
