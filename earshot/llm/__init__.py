"""Operators for training data made of text; nothing else in the library imports this subpackage."""
