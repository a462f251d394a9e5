"""Quality metrics over time windows, on streams and on tables."""
