"""The operators that add up, over unbounded input."""
