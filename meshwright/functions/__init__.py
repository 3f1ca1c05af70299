"""Cell metadata and column functions."""
