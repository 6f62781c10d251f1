"""sources of strataflow."""
