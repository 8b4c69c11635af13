"""Column helpers: millisecond arithmetic and window assigners."""
