"""Schemas, and the registered queries with their SQL."""
