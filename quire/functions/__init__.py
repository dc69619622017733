"""Functions on columns and strings."""
