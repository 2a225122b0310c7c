"""Operators for large training-text pipelines; nothing else in quantframe imports this package."""
