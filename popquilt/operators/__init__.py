"""Operators, by subject."""
