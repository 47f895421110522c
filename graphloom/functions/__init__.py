"""Column functions on paths and text."""
