"""The query catalogue of strataflow."""
