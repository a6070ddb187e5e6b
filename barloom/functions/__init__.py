"""Column functions and indicators."""
