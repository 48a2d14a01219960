"""Composed plans: track metrics, schedules and samplers."""
