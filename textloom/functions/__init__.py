"""Column expressions: text, hashes, inline runs, placeholders, numbers."""
