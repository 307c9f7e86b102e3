"""Requests and how they become DataFrame plans."""
