"""Operators of a training-data pipeline over `documents` and `embeddings`; nothing outside imports them."""
