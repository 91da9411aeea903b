"""Column functions: text normalisers, error counts, hashing and rounding."""
