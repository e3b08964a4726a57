"""Column expressions: code grammar, coded replies, text, numbers."""
