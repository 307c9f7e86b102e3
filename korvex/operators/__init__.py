"""Relational building blocks of queries."""
