"""Column functions: text, names, dates, vectors."""
