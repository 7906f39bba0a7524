"""Operators for training data; nothing outside this subpackage imports them."""
