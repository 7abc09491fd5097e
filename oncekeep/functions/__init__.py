"""Column expressions: text, IP, hashing, sketches, encryption."""
