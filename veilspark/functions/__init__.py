"""Masks and other column functions, as native Spark expressions wherever they can be."""
