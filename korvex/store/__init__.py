"""Versioned collections on Parquet."""
