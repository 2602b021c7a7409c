"""Continuous form of the forecast loop."""
