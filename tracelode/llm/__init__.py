"""Operators over texts and event sequences for training data."""
