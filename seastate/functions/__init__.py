"""Column expressions. Every function takes and returns Columns; no UDFs."""
