"""Candidate indexes: cells, quantised vectors, postings."""
