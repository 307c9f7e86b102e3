"""Scoring functions as Spark columns."""
