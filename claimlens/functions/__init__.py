"""Column expressions and scale-safe ordering helpers."""
