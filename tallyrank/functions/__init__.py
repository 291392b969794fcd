"""Column functions: text, numbers, arrays and vectors."""
