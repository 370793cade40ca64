"""plans of shoal."""
