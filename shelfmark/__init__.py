"""Catalogue pipelines on Spark: items, their measured attributes, and text search over them."""
