"""Column functions: text, token-id arrays, scores."""
