"""Operators for texts and training data. Nothing outside this folder imports it."""
