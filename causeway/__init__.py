"""Multiverse analytics for causal hypotheses on Spark."""
