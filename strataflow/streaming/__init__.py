"""streaming of strataflow."""
