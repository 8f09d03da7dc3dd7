"""Operators for preparing training data from text and vectors."""
