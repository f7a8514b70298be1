"""Operators of a training-data pipeline over ``documents`` and its side tables."""
