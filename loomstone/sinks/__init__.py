"""Exports and renderers."""
