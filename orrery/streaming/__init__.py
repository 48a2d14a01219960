"""Structured Streaming jobs over live series and logs."""
