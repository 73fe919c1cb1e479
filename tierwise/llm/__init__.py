"""Operators on documents and pages for training-data preparation."""
