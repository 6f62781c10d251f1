"""functions of strataflow."""
