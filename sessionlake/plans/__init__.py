"""Plans: the registered queries over the tables, and their DuckDB counterparts."""
