"""Operators for large text corpora (filters, models, near-duplicates, packing).

Nothing outside this package imports it; its queries and their SQL are in
``queries`` and ``oracle``."""
