"""Array kernels for words of Arrow string columns, used inside Spark tasks.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D, so words
never cross a document and every other byte (also UTF-8 ones) belongs to
one.  A-Z count as a-z.  Words are identified by a 64-bit polynomial hash
over random byte values, mixed at the end; with 10^9 distinct words the
chance of any collision is below 3 %.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

WINDOW = 1 << 16        # bytes hashed at once, a bound of the kernel's arrays
CHUNK_BYTES = 2 << 20   # text bytes per kernel call

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**64 - 1, 256, dtype=np.uint64)
_BYTE[65:91] = _BYTE[97:123]
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def _inverse(x: int) -> int:
    y = x
    for _ in range(6):
        y = y * (2 - x * y) % 2**64
    return y


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base % 2**64))
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_POW = _powers(int(_BASE), WINDOW + 1)
_INV = _powers(_inverse(int(_BASE)), WINDOW + 1)


def mix(x: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash (splitmix64's last steps)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words(NamedTuple):
    """Words of a string column: ``offsets`` (documents + 1) into ``hashes``;
    ``starts``/``ends`` are byte positions in ``data``."""

    hashes: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    data: np.ndarray


def _buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.cast(pa.large_string()).fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[offs[0]:offs[-1]], offs - offs[0]


def _hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    out = np.zeros(len(starts), np.uint64)
    i, n = 0, len(starts)
    while i < n:
        base = starts[i]
        j = int(np.searchsorted(ends, base + WINDOW, "right"))
        if j <= i:                      # one word longer than the window
            total, scale = np.zeros(1, np.uint64), np.ones(1, np.uint64)
            for at in range(int(base), int(ends[i]), WINDOW):
                part = _BYTE[data[at:min(at + WINDOW, int(ends[i]))]]
                total += (part * _POW[:len(part)]).sum(dtype=np.uint64, keepdims=True) * scale
                scale *= _POW[WINDOW]
            out[i] = total[0]
            i += 1
            continue
        span = _BYTE[data[base:ends[j - 1]]] * _POW[:ends[j - 1] - base]
        prefix = np.zeros(len(span) + 1, np.uint64)
        np.cumsum(span, out=prefix[1:])
        s, e = starts[i:j] - base, ends[i:j] - base
        out[i:j] = (prefix[e] - prefix[s]) * _INV[s]
        i = j
    return mix(out)


#: Separators of plain words: every ASCII byte but letters and digits.
MARKS = np.zeros(256, bool)
MARKS[:128] = [not chr(b).isalnum() for b in range(128)]


def _folded(data: np.ndarray) -> np.ndarray:
    """Capital letters of U+00C0 to U+00DE (two bytes in UTF-8) as small ones."""
    at = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
                        & (data[1:] != 0x97)) + 1
    if len(at):
        data = data.copy()
        data[at] += 0x20
    return data


def words(column: pa.Array, separators: np.ndarray = _SPACE, fold: bool = False) -> Words:
    """Words of every string of ``column`` (null: none); ``fold`` makes Latin
    capitals beyond ASCII small too."""
    data, offs = _buffers(column)
    if fold:
        data = _folded(data)
    if len(data) == 0:
        e = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint64), np.zeros(len(offs), np.int64), e, e, data)
    solid = ~separators[data]
    cut = offs[(offs > 0) & (offs < len(data))]
    before = np.empty_like(solid)
    before[0] = False
    before[1:] = solid[:-1]
    before[cut] = False
    starts = np.flatnonzero(solid & ~before)
    if len(starts) == 0:
        return Words(np.zeros(0, np.uint64), np.zeros(len(offs), np.int64), starts, starts, data)
    after = np.empty_like(solid)
    after[-1] = False
    after[:-1] = solid[1:]
    after[cut - 1] = False
    ends = np.flatnonzero(solid & ~after) + 1
    return Words(_hash_spans(data, starts, ends), np.searchsorted(starts, offs), starts, ends, data)


def chunks(batch: pa.RecordBatch, column: str = "text",
           size: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` of about ``size`` text bytes (a row at least)."""
    if batch.num_rows == 0:
        return
    _, offs = _buffers(batch.column(batch.schema.get_field_index(column)))
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + size, "right")) - 1)
        yield batch.slice(i, min(j, batch.num_rows) - i)
        i = j


def owners(offsets: np.ndarray) -> np.ndarray:
    """The document index of every word."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
