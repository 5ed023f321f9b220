"""Operators on the text of training data. Nothing outside this package imports it."""
