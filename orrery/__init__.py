"""A PySpark engine for multi-view trajectory data."""
