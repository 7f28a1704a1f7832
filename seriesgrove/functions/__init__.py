"""Column functions over series, and numpy models."""
