"""Scans, the level union and the market table."""
