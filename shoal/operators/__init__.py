"""operators of shoal."""
