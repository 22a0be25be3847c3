"""Benchmark decontamination by latent semantic retrieval.

1. Frequencies of the benchmark's words are counted over the whole corpus.
   Their inverse logarithms are the weights; words that make up ``STOP`` of
   the corpus have none, unless an item would keep fewer than ``LEAST`` words.
2. A randomised SVD of the TF-IDF matrix of the benchmark's passages gives the
   latent space; its products with the matrix are computed by the tasks that
   hold the passages.  Only directions of that space can make a cosine with a
   benchmark item, so corpus passages need no other.
3. Every corpus passage (two neighbouring blocks of ``BLOCK`` words, so
   passages overlap by half) is projected, and items are cut into passages of
   that size likewise; an item with a passage that has a cosine of ``COSINE``
   or more is a candidate, however long it is.
4. A candidate, as a whole, is aligned with the item by the words they share, and their
   longest common subsequence is taken there.  The document is contaminated
   by the item when the subsequence covers ``COPIED`` of the item, or
   ``PARAPHRASED`` of it with the answer, the item's last ``ANSWER`` words, in
   place up to one word.

Words are runs of letters and digits without regard to case (Latin letters),
so marks or capitals do not hide a copy.

The benchmark is used in parts of at most ``PART`` passages, each with a latent
space of full rank (a long item may stand in several); ``PARTS`` of them (some 64 MB) are broadcast per pass.

Cases: null or empty texts and items without a word take no part; documents
shorter than a block are one passage, long ones are searched whole; repeated
rows are judged one by one; repeated items each count; empty tables give an
empty result; a null id is reported as null; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peerlens.llm.text import MARKS, chunks, words
from peerlens.session import stored

BLOCK = 24
RANK, OVERSAMPLE, ITERATIONS = 256, 16, 2
COSINE = 0.3
STOP, LEAST = 1e-3, 4
COPIED, PARAPHRASED, ANSWER = 0.7, 0.5, 4
PART, PARTS = 240, 64
TOKENS = 1 << 13        # tokens projected at once


class Part(NamedTuple):
    """Some passages of the benchmark and their latent space."""

    items: list[int]            # item ids
    numbers: list[int]          # the items' numbers in their group of parts
    words: list[np.ndarray]     # their word hashes
    owner: list[int]            # the item of each passage
    begin: list[int]            # the first word of each passage in its item
    vocabulary: np.ndarray      # sorted hashes
    weight: np.ndarray          # idf by term (float32)
    space: np.ndarray           # terms x rank, rows weighted by idf
    targets: np.ndarray         # rank x passages, of unit TF-IDF vectors


def passages_of(words_: int) -> list[int]:
    """Where the passages of an item of so many words begin."""
    last = words_ - 2 * BLOCK
    return [*range(0, last, BLOCK), last] if last > 0 else [0]


def _blocks(w) -> tuple[np.ndarray, np.ndarray]:
    """The block of every word, and each document's first block."""
    n = np.diff(w.offsets)
    first = np.concatenate([[0], np.cumsum(-(-n // BLOCK))])
    within = np.arange(len(w.hashes)) - np.repeat(w.offsets[:-1], n)
    return np.repeat(first[:-1], n) + within // BLOCK, first


def _terms(hashes: np.ndarray, vocabulary: np.ndarray, screen: np.ndarray):
    """Positions of the words that are in the vocabulary, and their terms."""
    at = np.flatnonzero(screen[(hashes >> np.uint64(48)).astype(np.int64)])
    found = np.minimum(np.searchsorted(vocabulary, hashes[at]), len(vocabulary) - 1)
    ok = vocabulary[found] == hashes[at]
    return at[ok], found[ok]


def _screen(vocabulary: np.ndarray) -> np.ndarray:
    out = np.zeros(1 << 16, bool)
    out[(vocabulary >> np.uint64(48)).astype(np.int64)] = True
    return out


def word_frequencies(docs: DataFrame, vocabulary: np.ndarray) -> tuple[np.ndarray, int]:
    """How often each term stands in the corpus, and its number of words."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = shared.value
        screen, counts, total = _screen(vocab), np.zeros(len(vocab), np.int64), 0
        for batch in batches:
            for part in chunks(batch):
                hashes = words(part.column("text"), MARKS, True).hashes
                counts += np.bincount(_terms(hashes, vocab, screen)[1], minlength=len(vocab))
                total += len(hashes)
        term = np.r_[np.flatnonzero(counts), -1]
        yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(np.r_[counts[term[:-1]], total])],
                                         names=["term", "n"])

    rows = (docs.select("text").mapInArrow(run, "term long, n long").groupBy("term")
            .agg(F.sum("n").alias("n")).collect())       # a row per benchmark word
    counts, total = np.zeros(len(vocabulary), np.int64), 0
    for r in rows:
        if r["term"] < 0:
            total = r["n"]
        else:
            counts[r["term"]] = r["n"]
    return counts, total


def weights(vocabulary: np.ndarray, counts: np.ndarray, total: int,
            items: list[np.ndarray]) -> np.ndarray:
    """The terms' weights; 0 for stop words."""
    stop = counts >= max(1.0, STOP * total)
    for h in items:
        own = np.searchsorted(vocabulary, np.unique(h))
        if (~stop[own]).sum() < LEAST:
            stop[own] = False
    return np.where(stop, 0.0, np.log((total + 1) / (counts + 1)) + 0.01)


def randomised_svd(passages: DataFrame, vocabulary: np.ndarray, weight: np.ndarray, rank: int,
                   part: int) -> np.ndarray:
    """The leading right singular vectors (terms x rank) of the TF-IDF matrix of
    the passages (column ``text``) of a part.  Tasks return sums of rows'
    outer products with their projection, the driver only orthogonalises."""
    spark = passages.sparkSession
    mine = passages.where(F.col("part") == part).select("text")
    size = min(rank + OVERSAMPLE, len(vocabulary))
    basis = np.random.default_rng(part + 1).standard_normal((len(vocabulary), size))
    for _ in range(ITERATIONS + 1):
        shared = spark.sparkContext.broadcast((vocabulary, weight, np.linalg.qr(basis)[0]))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            vocab, idf, q = shared.value
            screen, total = _screen(vocab), np.zeros_like(q)
            for batch in batches:
                for terms, values in tfidf_rows(batch.column("text"), vocab, idf, screen):
                    total[terms] += np.outer(values, values @ q[terms])
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())],
                                             names=["sum"])

        basis = sum(np.frombuffer(r[0]).reshape(len(vocabulary), size)
                    for r in mine.coalesce(4).mapInArrow(run, "sum binary").collect())
        shared.unpersist()
    # the last product is (A'A) Q: its range is the leading right singular space
    u, _, _ = np.linalg.svd(basis, full_matrices=False)
    return u[:, :rank]


def tfidf_rows(column: pa.Array, vocab: np.ndarray, idf: np.ndarray, screen: np.ndarray):
    """Unit TF-IDF rows (terms, values) of every text that has a term."""
    w = words(column, MARKS, True)
    at, term = _terms(w.hashes, vocab, screen)
    cut = np.searchsorted(at, w.offsets)
    for a, b in zip(cut[:-1], cut[1:]):
        if b > a:
            terms, n = np.unique(term[a:b], return_counts=True)
            values = n * idf[terms].astype(float)
            if (norm := np.linalg.norm(values)) > 0:
                yield terms, values / norm


def lcs(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence (bit-parallel)."""
    places: dict[int, int] = {}
    for k, x in enumerate(a.tolist()):
        places[x] = places.get(x, 0) | 1 << k
    full = (1 << len(a)) - 1
    v = full
    for x in b.tolist():
        m = places.get(x, 0) & v
        if m:
            v = ((v + m) | (v - m)) & full
    return len(a) - v.bit_count()


def compare(item: np.ndarray, doc: np.ndarray, at: int, weight: dict[int, float]) -> tuple[float, bool]:
    """Share of the item that its best place near word ``at`` of the document
    covers in order, and whether the answer stands there."""
    n = len(item)
    lo, hi = max(0, at - n), min(len(doc), at + 2 * BLOCK + n)
    near = doc[lo:hi]
    where: dict[int, list[int]] = {}
    for k, x in enumerate(item.tolist()):
        where.setdefault(x, []).append(k)
    votes: dict[int, float] = {}
    slack = max(2, n // 8)
    for k, x in enumerate(near.tolist()):
        for i in where.get(x, ()):
            votes[(k - i) // slack] = votes.get((k - i) // slack, 0.0) + weight.get(x, 0.0)
    if not votes:
        return 0.0, False
    top = max(votes, key=lambda s: (votes[s] + votes.get(s - 1, 0) + votes.get(s + 1, 0), -s))
    begin = max(0, (top - 1) * slack)
    part = near[begin:(top + 2) * slack + n]
    answer = item[-min(ANSWER, n):]
    return lcs(item, part) / n, lcs(answer, part) >= len(answer) - 1


def _search(part: Part, screen: np.ndarray, column: pa.Array) -> Iterator[tuple[int, int, float, float, bool]]:
    """(row, item, cosine, share, answer) of the contaminated rows of a column."""
    w = words(column, MARKS, True)
    if len(w.hashes) == 0:
        return
    block, first = _blocks(w)
    at, term = _terms(w.hashes, part.vocabulary, screen)
    repeated = np.zeros(len(at), bool)
    repeated[1:] = (term[1:] == term[:-1]) & (at[1:] == at[:-1] + 1)
    at, term = at[~repeated], term[~repeated]
    if len(at) == 0:
        return
    b = block[at]
    own, start = np.unique(b, return_index=True)        # blocks with a term
    size = np.diff(np.r_[start, len(at)])
    z = np.empty((len(own), part.space.shape[1]), np.float32)
    for n in np.unique(size):                           # blocks with equally many terms
        group = np.flatnonzero(size == n)
        for k in range(0, len(group), step := max(1, TOKENS // n)):
            some = group[k:k + step]
            z[some] = part.space[term[start[some][:, None] + np.arange(n)]].sum(1)
    norm2 = np.add.reduceat(part.weight[term].astype(float) ** 2, start)
    doc_of = np.searchsorted(first, own, "right") - 1
    joined = np.zeros(len(own), bool)                   # the next block continues the passage
    joined[:-1] = (own[1:] == own[:-1] + 1) & (doc_of[1:] == doc_of[:-1])
    follow = np.flatnonzero(joined)
    zp, np2 = z.copy(), norm2.copy()
    zp[follow] += z[follow + 1]
    np2[follow] += norm2[follow + 1]
    best: dict[tuple[int, int], tuple[float, float, bool]] = {}
    tried: set[tuple[int, int, int]] = set()
    idf = None
    for i in range(0, len(own), 4096):
        cos = (zp[i:i + 4096] @ part.targets) / np.sqrt(np2[i:i + 4096] + 1e-12)[:, None]
        for p, k in zip(*np.nonzero(cos >= COSINE)):
            row, passage = int(doc_of[i + p]), k
            k = part.owner[passage]
            old = best.get((row, k))
            if old and old[1] >= 0.95:
                continue
            at_word, n = int(own[i + p] - first[row]) * BLOCK, len(part.words[k])
            if n > 2 * BLOCK:       # passages that put a long item in the same place
                place = row, k, (at_word - part.begin[passage]) // max(2 * BLOCK, n // 8)
                if place in tried:
                    continue
                tried.add(place)
            idf = idf or dict(zip(part.vocabulary.tolist(), part.weight.tolist()))
            doc = w.hashes[w.offsets[row]:w.offsets[row + 1]]
            share, answer = compare(part.words[k], doc, at_word, idf)
            if old is None or share > old[1]:
                best[row, k] = float(cos[p, passage]), share, answer
    for (row, k), (cosine, share, answer) in best.items():
        if share >= COPIED or share >= PARAPHRASED and answer:
            yield row, k, cosine, share, answer


def parts(docs: DataFrame, benchmark: DataFrame, id_col: str = "item_id",
          text_col: str = "text") -> Iterator[list[Part]]:
    """The benchmark's parts, ``PARTS`` at a time.  ``docs``: column ``text``."""
    items = benchmark.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("item"), F.col(text_col).alias("text"))
    # an item's passages, at some six characters a word
    long = F.greatest(F.lit(0), F.length("text") - 12 * BLOCK)
    count = items.agg(F.coalesce(F.sum(1 + F.ceil(long / (6 * BLOCK))), F.lit(0))).first()[0]
    groups = max(1, -(-count // (PART * PARTS)))
    for g in range(groups):
        mine = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(groups)) == g)
        rows = sorted(mine.collect(), key=lambda r: (r["item"], r["text"]))     # one group
        kept, cut = [], []          # (id, words) of items; (item, first word, text) of passages
        for r in rows:
            w = words(pa.array([r["text"]], pa.string()), MARKS, True)
            for begin in passages_of(n) if (n := len(w.hashes)) else ():
                end = min(n, begin + 2 * BLOCK)
                cut.append((len(kept), begin,
                            w.data[w.starts[begin]:w.ends[end - 1]].tobytes().decode("utf-8", "replace")))
            if n:
                kept.append((r["item"], w.hashes))
        if not kept:
            continue
        vocabulary = np.unique(np.concatenate([h for _, h in kept]))
        idf = weights(vocabulary, *word_frequencies(docs, vocabulary), [h for _, h in kept])
        numbered = [(k // PART, text) for k, (*_, text) in enumerate(cut)]
        passages = stored(docs.sparkSession.createDataFrame(numbered, "part int, text string"),
                          "benchmark-passages")
        out = []
        for p in range(numbered[-1][0] + 1):
            some = cut[p * PART:(p + 1) * PART]
            mine = sorted({k for k, *_ in some})
            vocab = np.unique(np.concatenate([kept[k][1] for k in mine]))
            weight = idf[np.searchsorted(vocabulary, vocab)]
            vocab, weight = vocab[weight > 0], weight[weight > 0]
            v = randomised_svd(passages, vocab, weight, min(RANK, len(some), len(vocab)), p)
            screen, targets = _screen(vocab), np.zeros((v.shape[1], len(some)), np.float32)
            for k, (*_, text) in enumerate(some):
                for terms, values in tfidf_rows(pa.array([text], pa.string()), vocab, weight, screen):
                    targets[:, k] = values @ v[terms]
            out.append(Part([kept[k][0] for k in mine], mine, [kept[k][1] for k in mine],
                            [mine.index(k) for k, *_ in some], [begin for _, begin, _ in some], vocab,
                            weight.astype(np.float32), (v * weight[:, None]).astype(np.float32),
                            targets))
        yield out


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id",
                 text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """id, item_id, cosine, lcs_share and answer_found of every contaminated
    document and the items it contains."""
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = source.schema["id"].dataType.simpleString()
    schema = f"id {id_type}, item_id long, cosine double, lcs_share double, answer_found boolean"
    out = spark.createDataFrame([], schema)
    for group in parts(source, benchmark, item_col):
        shared = spark.sparkContext.broadcast(group)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            screens = [_screen(p.vocabulary) for p in shared.value]
            for batch in batches:
                for piece in chunks(batch):
                    best = {}       # an item of several parts is reported once
                    for part, screen in zip(shared.value, screens):
                        for row, k, *found in _search(part, screen, piece.column("text")):
                            key = row, part.numbers[k]
                            if key not in best or found[1] > best[key][3]:
                                best[key] = row, part.items[k], *found
                    if best:
                        row, item, cosine, share, answer = zip(*best.values())
                        yield pa.RecordBatch.from_arrays(
                            [piece.column("id").take(pa.array(row)),
                             pa.array(item, pa.int64()),
                             pa.array(cosine), pa.array(share), pa.array(answer)],
                            names=["id", "item_id", "cosine", "lcs_share", "answer_found"])

        out = out.union(source.mapInArrow(run, schema))
    return out.withColumnRenamed("id", id_col)


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text",
          item_col: str = "item_id") -> DataFrame:
    """The documents that no item contaminates, with all their columns."""
    spark = docs.sparkSession
    out = docs
    for group in parts(docs.select(F.col(text_col).alias("text")), benchmark, item_col):
        shared = spark.sparkContext.broadcast(group)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            screens = [_screen(p.vocabulary) for p in shared.value]
            for batch in batches:
                for piece in chunks(batch, text_col):
                    column = piece.column(piece.schema.get_field_index(text_col))
                    keep = np.ones(piece.num_rows, bool)
                    for part, screen in zip(shared.value, screens):
                        keep[[row for row, *_ in _search(part, screen, column)]] = False
                    yield piece.filter(pa.array(keep))

        out = out.mapInArrow(run, docs.schema)
    return out
