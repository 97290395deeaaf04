"""Column functions: coercion of loose document values, and text."""
