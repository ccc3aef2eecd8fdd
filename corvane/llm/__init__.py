"""Operators for training data and for reading human text; nothing else in the library imports them."""
