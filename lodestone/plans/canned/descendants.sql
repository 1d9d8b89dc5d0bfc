-- All that extends a class, directly or not.
-- :name TEXT
-- @entity descendant object
SELECT child AS descendant FROM ancestor_chain WHERE parent = lower($name) ORDER BY 1
