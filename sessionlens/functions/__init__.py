"""Column builders: text and statistics."""
