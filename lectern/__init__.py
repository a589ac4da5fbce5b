"""Lectern: document-knowledge analytics expressed as PySpark DataFrames."""
