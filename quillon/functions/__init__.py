"""Column functions for cells, lists, ranges and casts."""
