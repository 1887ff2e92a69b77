"""The verification workload: flows derived from the given tables, queries, SQL twins."""
