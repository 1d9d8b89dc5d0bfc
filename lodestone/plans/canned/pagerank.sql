-- The objects of the highest rank.
-- :n INT 10
-- @entity object object
SELECT object, round(pagerank, 6) AS pagerank, in_degree, out_degree, max_cyclomatic FROM object_metrics ORDER BY pagerank DESC, object LIMIT $n
