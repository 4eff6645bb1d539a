"""Bucketed activity over streams."""
