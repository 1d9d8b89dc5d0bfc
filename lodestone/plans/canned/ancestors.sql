-- The ancestors of an object or control with their depth, nearest first.
-- :name TEXT
SELECT depth, parent FROM ancestor_chain WHERE child = lower($name) ORDER BY depth
