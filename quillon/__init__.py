"""Keyed-table and knowledge-graph analytics expressed as Spark DataFrame plans."""
