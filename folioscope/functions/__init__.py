"""Column functions and aggregate expressions."""
