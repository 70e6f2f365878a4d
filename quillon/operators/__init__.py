"""Operators on keyed tables: each takes tables and returns a table or DataFrame, lazily."""
