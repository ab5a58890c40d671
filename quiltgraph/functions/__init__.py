"""Column functions and ranking helpers."""
