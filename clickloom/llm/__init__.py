"""Operators for training-data pipelines over whole tables; nothing else in the library imports this package."""
