"""Operators for training data: text, pages and conversations."""
