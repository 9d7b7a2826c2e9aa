"""Operators on the texts and values of training data. Nothing else in the library imports this subpackage."""
