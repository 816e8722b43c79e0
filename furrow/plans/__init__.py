"""End-to-end plans, the query registry and the SQL each query is checked with."""
