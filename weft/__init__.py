"""weft: change-set analytics as Spark tables and joins."""
