"""Column functions: geometry, rounding, text and JSON."""
