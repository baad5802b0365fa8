"""Operators for training data: splits, runs, truncation, duplicates, tokens, mixes and text quality."""
