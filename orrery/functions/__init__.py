"""Column functions: geometry, arrays, text, numbers."""
