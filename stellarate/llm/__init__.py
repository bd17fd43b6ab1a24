"""Operators of a training-data pipeline: licences, near copies, repeats, quality, tokens."""
