"""Column expressions and argument readers."""
