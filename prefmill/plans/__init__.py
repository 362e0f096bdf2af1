"""Stage compositions, fixtures over the given tables, and the query catalog."""
