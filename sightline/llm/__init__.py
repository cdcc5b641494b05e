"""Operators of a training-data pipeline over a table of documents.

Nothing else in the library imports this subpackage; it imports nothing of the
rest either, so both can be installed or removed alone.
"""
