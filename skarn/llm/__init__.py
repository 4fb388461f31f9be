"""Operators for training data: text pairs, vectors, duplicates, tokens, packing, personal information."""
