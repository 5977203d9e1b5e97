"""Incremental label import."""
