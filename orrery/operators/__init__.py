"""Relational operators on tracks, cameras, points and reports."""
