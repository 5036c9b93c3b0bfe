"""Operators on text collections for training data. Nothing outside imports this package."""
