"""Operators for preparing and checking training data."""
