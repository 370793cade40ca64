"""sources of shoal."""
