"""Column functions: arithmetic, feature vectors, identifiers, hashing."""
