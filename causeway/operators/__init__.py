"""Relational operators over claims, packed models and pairs of models."""
