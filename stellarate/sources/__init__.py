"""Reading and writing the review tables."""
