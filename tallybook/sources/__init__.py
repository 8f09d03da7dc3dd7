"""Readers: files to DataFrames in document order."""
