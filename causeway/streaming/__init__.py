"""Incremental upkeep of pair tables."""
