"""Column helpers and the skew-safe building blocks."""
