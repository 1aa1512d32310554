"""Sextant: text-collection search, reference graphs and retrieval evaluation as Spark plans."""
