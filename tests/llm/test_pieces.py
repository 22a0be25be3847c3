"""Texts are taken in pieces of a bounded size."""

from __future__ import annotations

import pyarrow as pa

from peerlens.llm import resample, text


def test_pieces_keep_all_rows_within_the_size():
    rows = ["x" * n for n in (10, 900, 400, 400, 300, 5000, 1)] + [None, "y"]
    batch = pa.RecordBatch.from_arrays([pa.array(rows)], names=["text"])
    pieces = [p.column("text").to_pylist() for p in text.chunks(batch, size=1000)]
    assert sum(pieces, []) == rows
    assert all(len(p) == 1 or sum(len(t or "") for t in p) <= 1000 for p in pieces)
    assert resample.PIECE_BYTES < text.CHUNK_BYTES
