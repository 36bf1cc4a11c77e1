"""Operators on texts for training data: packing, evaluation leaks and shared spans."""
