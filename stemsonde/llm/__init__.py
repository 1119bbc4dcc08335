"""Operators of a training-data pipeline; see README.md. Nothing else in the library imports them."""
