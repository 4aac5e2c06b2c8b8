"""Structured Streaming form of the hourly panel (panel_stream)."""
