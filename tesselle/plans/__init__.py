"""Composite plans, and the queries that show every operator."""
