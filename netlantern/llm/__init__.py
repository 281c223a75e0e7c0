"""Corpus preparation for training data; nothing else in the library depends on it."""
