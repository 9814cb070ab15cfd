"""Workflows over several operators and the query registry."""
