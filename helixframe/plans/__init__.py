"""Portable plans, named configurations, and the query catalogue."""
