"""Packing by power-of-two decomposition.

A document's token ids, closed by one end id, are cut into pieces whose
lengths are the powers of two of its length's binary form, full windows
first.  Every piece is a sequence of its own: pieces of equal length form a
bucket from which batches are drawn, nothing is padded and no sequence
crosses documents.

Tokenizing goes word by word.  The tokenizer's normalizer and splitter never
join across ASCII white space, so the ids of a text are those of its words in
turn; bounded caches hold the ids of words, for a task, and of their parts, for
the worker's life.
Words with characters outside ``_PLAIN`` go through the whole tokenizer.

Cases: a null or empty text has only the end id; very long texts are cut like
any; repeated rows are packed one by one; null ids stay null; an empty table
gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 2048
END_ID = 1
MAX_WORDS = 200_000     # cached words, and as many cached parts, per worker
BLOCK_IDS = 1 << 19     # ids in a batch of results
MAX_CACHED = 40         # longer words are not cached

#: ASCII and Latin letters that normalizing leaves alone and that lower-case one to one.
_PLAIN = re.compile("[!-~À-ÖØ-öø-įı-ɏ]+")
#: White space that ends a word, and the further kind that str.split() cuts at.
_SPACE = re.compile("[ \t\n\x0b\x0c\r]+")
_OTHER = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def _byte_letters() -> dict[int, str]:
    """The letters by which byte-level vocabularies write bytes: printable
    ones stand for themselves, the others follow from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class WordTokenizer:
    """Ids of texts as little-endian unsigned 32-bit bytes, with caches."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            self.whole = Tokenizer.from_str(f.read())
        self.letters = _byte_letters()
        self.words: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.model = self.whole.model
        self.find = regex.compile(self._pattern()).findall

    def _pattern(self) -> str:
        """The splitter's pattern, from the tokenizer's own description."""
        import json
        steps = json.loads(self.whole.to_str())["pre_tokenizer"]["pretokenizers"]
        return next(s["pattern"]["Regex"] for s in steps if s["type"] == "Split")

    def _part(self, part: str) -> bytes:
        if (ids := self.parts.get(part)) is None:
            text = part.encode().decode("latin-1").translate(self.letters)
            ids = np.array([t.id for t in self.model.tokenize(text)], "<u4").tobytes()
            if len(self.parts) < MAX_WORDS and len(part) <= MAX_CACHED:
                self.parts[part] = ids
        return ids

    def _word(self, word: str) -> bytes:
        if _PLAIN.fullmatch(word) and "<|" not in word:
            ids = b"".join(map(self._part, self.find(word.lower())))
        else:
            got = self.whole.encode(word, add_special_tokens=False).ids
            ids = np.array(got, "<u4").tobytes()
        if len(self.words) < MAX_WORDS and len(word) <= MAX_CACHED:
            self.words[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        words = _SPACE.split(text) if _OTHER.search(text) else text.split()
        get, slow = self.words.get, self._word
        return b"".join([get(w) or (slow(w) if w else b"") for w in words])


_loaded: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """The worker's tokenizer for a vocabulary file, kept with its caches."""
    if path not in _loaded:
        _loaded[path] = WordTokenizer(path)
    return _loaded[path]


def pieces(length: int, window: int = WINDOW) -> list[int]:
    """Piece lengths of a document: full windows, then its powers of two from
    the largest down.  ``window`` is a power of two."""
    rest = length % window
    return [window] * (length // window) + [1 << k for k in range(rest.bit_length() - 1, -1, -1)
                                            if rest >> k & 1]


def pack(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
         window: int = WINDOW, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """One row per piece: id, start (ids of the document before it), length,
    ids (only if ``with_ids``), ids_crc32, doc_tokens, sequence_id and offset
    (0: a piece fills its sequence).  ``length`` is the bucket.

    A map over the scan without any shuffle.  Sequence ids are the task's
    number and a count in it, so a task that is run again gives the same."""
    if window & (window - 1) or window < 1:
        raise ValueError("the window is a power of two")
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = docs.schema["id"].dataType.simpleString()
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path)

        def block(rows: list) -> pa.RecordBatch:
            at, start, length, crc, total, ids = zip(*rows)
            columns = [batch.column("id").take(pa.array(at, pa.int64())),
                       pa.array(start, pa.int64()), pa.array(length, pa.int64()),
                       pa.array(crc, pa.int64()), pa.array(total, pa.int64())]
            names = ["id", "start", "length", "ids_crc32", "doc_tokens"]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(
                    np.concatenate([[0], np.cumsum(length)]).astype(np.int32),
                    pa.array(np.frombuffer(b"".join(ids), "<u4").astype(np.int32))))
                names.append("ids")
            return pa.RecordBatch.from_arrays(columns, names=names)

        for batch in batches:
            rows, held = [], 0
            for k, text in enumerate(batch.column("text")):
                raw = tok.encode(text.as_py() or "") + end
                n, start = len(raw) // 4, 0
                view = memoryview(raw)
                for size in pieces(n, window):
                    piece = view[4 * start:4 * (start + size)]
                    rows.append((k, start, size, crc32(piece), n, piece if with_ids else None))
                    start += size
                    held += size
                    if held > BLOCK_IDS:
                        yield block(rows)
                        rows, held = [], 0
            if rows:
                yield block(rows)
        tok.words.clear()               # a worker that waits keeps little
        pa.default_memory_pool().release_unused()

    schema = (f"id {id_type}, start long, length long, ids_crc32 long, doc_tokens long"
              + ", ids array<int>" * with_ids)
    packed = docs.mapInArrow(run, schema)
    return packed.select(F.col("id").alias(id_col), "start", "length", "ids_crc32", "doc_tokens",
                         F.monotonically_increasing_id().alias("sequence_id"),
                         F.lit(0).cast("long").alias("offset"), *["ids"] * with_ids)


def write_buckets(packed: DataFrame, path: str) -> None:
    """Write sequences in a folder per length, from which equal lengths are read."""
    packed.write.mode("overwrite").partitionBy("length").parquet(path)
