"""Incremental form of the corpus build."""
