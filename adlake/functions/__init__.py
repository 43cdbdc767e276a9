"""Column expressions: text in, Column out, no Python in the row path."""
