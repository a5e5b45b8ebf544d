"""Operators for large training-data corpora, one module each, and their queries (``queries.py``)."""
