"""Column and record functions."""
