"""Readers and writers of collection files."""
