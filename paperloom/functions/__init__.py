"""Column functions: text in, column out."""
