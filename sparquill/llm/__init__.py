"""Operators for preparing training data at corpus scale, each with its registered query."""
