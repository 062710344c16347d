"""Measurement curation and search on PySpark."""
