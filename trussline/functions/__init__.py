"""Column functions: canonical text, hashes, value states, matrices."""
