"""Readers and writers of keyed tables."""
