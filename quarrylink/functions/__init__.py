"""Column expressions: text normalization and string similarity."""
