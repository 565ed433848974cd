"""Column functions: text forms, hashes, ordering keys, vectors, validators."""
