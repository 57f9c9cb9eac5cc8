"""Whole queries and their oracles."""
