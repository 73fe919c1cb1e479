"""Compositions of operators: metric tables and reports."""
