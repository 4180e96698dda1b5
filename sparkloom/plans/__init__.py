"""Plan helpers."""
