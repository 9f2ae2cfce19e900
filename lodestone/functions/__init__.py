"""Column functions: text, vectors, scores."""
