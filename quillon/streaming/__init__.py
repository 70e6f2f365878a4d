"""Keyed tables as streams."""
