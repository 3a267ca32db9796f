"""Lodestone: product-search and conversation analytics as PySpark DataFrame operators."""
