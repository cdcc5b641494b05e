"""Fixture views, queries and their SQL."""
