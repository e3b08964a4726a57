"""Registered queries: each a composition of operators over the given tables."""
