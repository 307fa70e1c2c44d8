"""Operators for training data: consensus, splits, top-N, overlaps, packing and text statistics."""
