"""Readers and writers of the file and wire formats."""
