"""Expression language and column functions."""
