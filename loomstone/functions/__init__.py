"""Column functions: bucket keys, message parsing, line and path predicates."""
