"""Column expressions and vectorised statistics."""
