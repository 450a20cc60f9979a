"""Column functions: text, names, formats."""
