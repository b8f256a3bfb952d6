"""Column functions: units, text and flags, geometry, scores."""
