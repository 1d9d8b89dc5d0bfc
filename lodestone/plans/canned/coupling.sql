-- The busiest pairs of calling object and called name, beyond three calls.
-- :n INT 20
WITH pairs AS (SELECT object AS caller, to_name AS callee, sum(1) AS edge_count FROM call_sites WHERE NOT object <=> to_name GROUP BY ALL)
SELECT caller, callee, edge_count FROM pairs WHERE edge_count > 3 AND callee IS NOT NULL ORDER BY edge_count DESC, caller, callee LIMIT $n
