"""operators of strataflow."""
