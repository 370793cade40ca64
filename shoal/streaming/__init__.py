"""streaming of shoal."""
