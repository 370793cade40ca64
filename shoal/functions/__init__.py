"""functions of shoal."""
