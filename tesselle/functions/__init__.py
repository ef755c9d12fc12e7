"""Column expressions on pixels."""
