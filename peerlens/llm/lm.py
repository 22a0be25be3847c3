"""Language-model scoring with a weighted backoff automaton.

The model is an absolutely discounted backoff model over words, each text
ending in one end token.  Unknown words share one class whose mass the
discount of the known words pays for, so probabilities sum to one over the
known words and that class.  Kept n-grams are the states of an automaton: a
state has an arc per kept continuation and one failure arc, weighted by its
backoff, to the state of the next shorter suffix.  Following arcs, or failure
arcs where none fits, adds up log10 probabilities.

Distribution.  An n-gram is kept from ``LEAST`` occurrences in the training
texts on, whatever its words, so the model grows with the input.  Texts are cut
into blocks of about ``BLOCK`` tokens.  A block sends each of its distinct words,
pairs and triples once, with its training count, to the n-gram's bucket (a range
of the hashes; there is a bucket per ``BUCKET`` bytes of text).  The bucket adds
up and answers every block in the order of its question, so an answer holds
counts and no keys, and an n-gram that is not kept takes next to nothing.  For
each kept n-gram one of its blocks adds its arc to the masses of its context;
contexts go to their buckets and come back as failure weights.  With both
answers a block has the automaton's part that its texts pass through.  Sorted
keys travel as compressed differences.

Cases: a null or empty text has only its end token; a null id counts as the
empty id for the split; repeated rows are scored one by one; without training
tokens the unknown class has probability one; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peerlens.llm.text import chunks, owners, words
from peerlens.session import released, stored

WORD_SHARE = 1e-6       # of an earlier form, set by a test; nothing depends on a word's share
LEAST = 2               # occurrences of a kept n-gram
DISCOUNT = 0.75         # of n-grams of two and three words
SEGMENT = 256           # tokens a lockstep lane walks
BLOCK = 1 << 20         # tokens of a block, but for its last piece of texts
BUCKET = 8 << 20        # text bytes per bucket

END = np.uint64(0x0F1E2D3C4B5A6978)     # the end token's hash
#: Odd factors: a pair's key is LEFT * word + RIGHT * word, a triple's
#: LEFT3 * pair + RIGHT3 * pair (mod 2^64), so key and context give the other part.
LEFT, RIGHT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
LEFT3, RIGHT3 = np.uint64(0xD6E8FEB86659FD93), np.uint64(0x165667B19E3779F9)


def tokens(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes with an end token after each text, and document offsets."""
    w = words(batch.column("text"))
    n = batch.num_rows
    out = np.full(len(w.hashes) + n, END)
    out[np.arange(len(w.hashes)) + owners(w.offsets)] = w.hashes
    return out, w.offsets + np.arange(n + 1)


class Unigrams(NamedTuple):
    """Frequent words by hash, and what the whole count table adds up to."""

    hashes: np.ndarray      # uint64, sorted
    counts: np.ndarray      # training counts
    n: int                  # N: training tokens
    v: int                  # V: distinct training tokens
    discount: float
    states: np.ndarray      # positions in hashes of the words with training counts

    def known(self, c):
        return (c - self.discount) / self.n

    @property
    def unknown(self) -> float:
        return self.discount * self.v / self.n if self.n else 1.0


class Lookup:
    """Maps hashes or integer keys to their position in a sorted array, -1 if absent."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys

    def __call__(self, wanted: np.ndarray) -> np.ndarray:
        if len(self.keys) == 0:
            return np.full(len(wanted), -1, np.int64)
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, at, -1)


def _state_ids(state_hashes: np.ndarray, toks: np.ndarray) -> np.ndarray:
    return Lookup(state_hashes)(toks)


def ngrams(toks: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, ...]:
    """Keys of the pairs and triples of a text that begin at each token, and
    whether one does."""
    if len(toks) < 2:
        none = np.zeros(0, np.uint64)
        return none, none.astype(bool), none, none.astype(bool)
    owner = owners(offs)
    two = LEFT * toks[:-1] + RIGHT * toks[1:]
    three = LEFT3 * two[:-1] + RIGHT3 * two[1:]
    return two, owner[:-1] == owner[1:], three, owner[:-2] == owner[2:]


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, a place of each, and every key's number among them."""
    order = np.argsort(keys)
    by_key = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = by_key[1:] != by_key[:-1]
    number = np.empty(len(keys), np.int64)
    number[order] = np.cumsum(new) - 1
    return by_key[new], order[new], number


def pack(values: np.ndarray) -> bytes:
    """Numbers: which are not zero, and those, compressed byte by byte of their width."""
    some = values != 0
    mask = pa.compress(np.packbits(some).tobytes(), "zstd", asbytes=True)
    planes = values[some].view(np.uint8).reshape(-1, values.itemsize).T.tobytes()
    return (len(values).to_bytes(8, "little") + len(mask).to_bytes(8, "little") + mask
            + pa.compress(planes, "zstd", asbytes=True))


def unpack(data: bytes, dtype) -> np.ndarray:
    n, mask = int.from_bytes(data[:8], "little"), 16 + int.from_bytes(data[8:16], "little")
    some = np.unpackbits(np.frombuffer(pa.decompress(data[16:mask], -(-n // 8), "zstd"), np.uint8),
                         count=n).astype(bool)
    out, width = np.zeros(n, dtype), np.dtype(dtype).itemsize
    held = int(some.sum())
    planes = np.frombuffer(pa.decompress(data[mask:], held * width, "zstd"), np.uint8)
    out[some] = np.ascontiguousarray(planes.reshape(width, held).T).view(dtype).reshape(-1)
    return out


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys."""
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_keys(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, np.uint64), dtype=np.uint64)


def in_blocks(source: DataFrame) -> DataFrame:
    """(block, words, toks, lengths, ids, train): texts as numbers of their
    block's sorted distinct words."""
    id_type = source.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        held, size = [], 0

        def emit() -> pa.RecordBatch:
            toks, lengths, ids, train = zip(*held)
            keys, _, number = distinct(np.concatenate(toks))
            one = lambda x: pa.ListArray.from_arrays([0, len(x)], x)
            return pa.RecordBatch.from_arrays(
                [pa.array([block]), pa.array([pack_keys(keys)]), pa.array([pack(number.astype(np.int32))]),
                 one(pa.array(np.concatenate(lengths))), one(pa.concat_arrays(ids)), one(pa.concat_arrays(train))],
                names=["block", "words", "toks", "lengths", "ids", "train"])

        for batch in batches:
            for part in chunks(batch):
                toks, offs = tokens(part)
                held.append((toks, np.diff(offs), part.column("id"), part.column("train")))
                size += len(toks)
                if size >= BLOCK:
                    yield emit()
                    held, size, block = [], 0, block + 1
        if held:
            yield emit()

    return source.mapInArrow(run, "block long, words binary, toks binary, lengths array<long>, "
                                  f"ids array<{id_type}>, train array<boolean>")


class Block:
    """A block's n-grams of 1 to ``order`` words, by length: the sorted distinct
    ``keys``, a token ``at`` which each begins, and ``which`` begins at every
    token (-1: none)."""

    def __init__(self, words: bytes, toks: bytes, lengths: np.ndarray, order: int):
        hashes, number = unpack_keys(words), unpack(toks, np.int32).astype(np.int64)
        self.offs = np.r_[0, np.cumsum(lengths)]
        self.keys, self.at, self.which = [hashes], [None], [number]
        two, in_two, three, in_three = ngrams(hashes[number], self.offs)
        for keys, inside in ((two, in_two), (three, in_three))[:order - 1]:
            begin = np.flatnonzero(inside)
            uniq, one, place = distinct(keys[begin])
            which = np.full(len(number), -1, np.int64)
            which[begin] = place
            self.keys.append(uniq)
            self.at.append(begin[one])
            self.which.append(which)

    @classmethod
    def of(cls, table: pa.Table, k: int, order: int) -> Block:
        return cls(table.column("words")[k].as_py(), table.column("toks")[k].as_py(),
                   table.column("lengths")[k].values.to_numpy(), order)


def to_buckets(block: int, length: int, keys: np.ndarray, buckets: int,
               **columns: np.ndarray) -> Iterator[dict]:
    """Questions: sorted keys, with columns, cut at the bounds of the buckets."""
    bucket = ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    cut = np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))
    for k in np.flatnonzero(np.diff(cut)):
        i, j = cut[k], cut[k + 1]
        yield {"block": block, "length": length, "bucket": int(k), "keys": pack_keys(keys[i:j]),
               **{name: pack(values[i:j]) for name, values in columns.items()}}


def _joined(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A bucket's questions: their sizes, and for all keys the sorted order and
    the beginning and number of equal ones."""
    parts = [unpack_keys(x.as_py()) for x in table.column("keys")]
    keys = np.concatenate(parts)
    order = np.argsort(keys)
    by_key = keys[order]
    first = np.flatnonzero(np.r_[True, by_key[1:] != by_key[:-1]])
    return np.array([len(p) for p in parts]), order, first, np.diff(np.r_[first, len(keys)])


def _column(table: pa.Table, name: str, dtype) -> np.ndarray:
    return np.concatenate([unpack(x.as_py(), dtype) for x in table.column(name)])


def _answers(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.array([pack(x) for x in np.split(values, np.cumsum(sizes)[:-1])], pa.binary())


def _answer(table: pa.Table, length: int, dtype) -> np.ndarray:
    """What all buckets answered a block on its n-grams of a length."""
    own = table.filter(np.asarray(table.column("length")) == length).sort_by("bucket")
    return _column(own, "answer", dtype) if own.num_rows else np.zeros(0, dtype)


def count(table: pa.Table) -> pa.Table:
    """Training counts of a bucket's n-grams for the blocks that ask: twice the
    count (0: not kept), plus 1 for the one block that adds the n-gram's arc.
    The first row has the bucket's tokens, distinct words, and words of counts
    1 and 2."""
    sizes, order, first, times = _joined(table)
    train = _column(table, "train", np.int64)[order]
    n = np.add.reduceat(train, first)
    word = table.column("length")[0].as_py() == 1
    kept = n >= (1 if word else LEAST)
    answer = np.empty(len(order), np.int64)
    answer[order] = np.repeat(np.where(kept, 2 * n, 0), times)
    adds = np.maximum.reduceat(np.where(train > 0, np.arange(len(order)), -1), first)
    answer[order[adds[kept]]] += 1
    sums = (n.sum(), (n > 0).sum(), (n == 1).sum(), (n == 2).sum())
    return pa.table({**{c: table.column(c) for c in ("block", "length", "bucket")},
                     "answer": _answers(answer, sizes),
                     **{c: pa.array([int(x) * word] + [0] * (len(sizes) - 1), pa.int64())
                        for c, x in zip(("n", "v", "n1", "n2"), sums)}})


def fail(table: pa.Table) -> pa.Table:
    """Failure weights of a bucket's contexts: log10 of the mass that their arcs
    leave over the mass that the shorter contexts' arcs leave."""
    sizes, order, first, times = _joined(table)
    high, low = (np.add.reduceat(_column(table, c, float)[order], first) for c in ("high", "low"))
    weight = np.log10(np.maximum(1 - high, 1e-12) / np.maximum(1 - low, 1e-12))
    answer = np.empty(len(order))
    answer[order] = np.repeat(weight, times)
    return pa.table({**{c: table.column(c) for c in ("block", "length", "bucket")},
                     "answer": _answers(answer, sizes)})


class Totals(NamedTuple):
    """What the whole count table adds up to."""

    n: int                  # N: training tokens
    v: int                  # V: distinct training tokens
    discount: float

    @property
    def log_unknown(self) -> float:
        return math.log10(self.discount * self.v / self.n) if self.n else 0.0

    def known(self, n: np.ndarray) -> np.ndarray:
        return (n - self.discount) / max(1, self.n)


def totals(counts: DataFrame) -> Totals:
    n, v, n1, n2 = counts.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("n", "v", "n1", "n2"))).first()
    return Totals(n, v, min(0.9, max(0.1, n1 / (n1 + 2 * n2))) if n1 else 0.1)


def steps(block: Block, n: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """The steps of all tokens at once, as the state before a token depends on
    the two tokens before it alone: for contexts of two words, then of one, the
    tokens met in such a state, the context, the n-gram that would be its arc,
    and whether it is one (else the failure arc leads on).  ``n``: counts of the
    block's n-grams (0: not kept)."""
    looking = np.ones(len(block.which[0]), bool)
    for back in range(len(n) - 1, 0, -1):
        context, arc = (w[:len(looking) - back] for w in block.which[back - 1:back + 1])
        at = np.flatnonzero(looking[back:] & (arc >= 0))
        at = at[n[back - 1][context[at]] > 0]
        fits = n[back][arc[at]] > 0
        yield back, at + back, context[at], arc[at], fits
        looking[at[fits] + back] = False


def contexts(block: Block, said: list[np.ndarray]) -> list[np.ndarray]:
    """Which contexts, by length, a block asks for: where a text takes the
    failure arc or the block adds an arc.  ``said``: the answers of ``count``."""
    out = [np.zeros(len(x), bool) for x in said[:-1]]
    for back, _, context, _, fits in steps(block, [x >> 1 for x in said]):
        out[back - 1][context[~fits]] = True
        out[back - 1][block.which[back - 1][block.at[back][said[back] & 1 > 0]]] = True
    return out


def walk(block: Block, n: list[np.ndarray], weight: list[np.ndarray], own: Totals) -> np.ndarray:
    """log10 probability of every token: the weights of the failure arcs and of
    the arc it takes.  ``weight``: failure weights of the contexts."""
    out = np.zeros(len(block.which[0]))
    alone = np.ones(len(out), bool)
    for back, at, context, arc, fits in steps(block, n):
        out[at[fits]] += np.log10((n[back][arc[fits]] - DISCOUNT) / n[back - 1][context[fits]])
        out[at[~fits]] += weight[back - 1][context[~fits]]
        alone[at[fits]] = False
    known = n[0] > 0
    logp = np.full(len(known), own.log_unknown)
    logp[known] = np.log10(own.known(n[0][known]))
    out[alone] += logp[block.which[0][alone]]
    return out


class Automaton:
    """States: -1 (empty), a word id below S, or S + the place of a pair.

    ``arc2``/``arc3`` hold the log10 weights of the arcs, ``fail1``/``fail2``
    those of the failure arcs of word and pair states."""

    def __init__(self, uni: Unigrams, pairs=None, triples=None):
        empty = np.zeros(0, np.int64)
        k2, c2 = pairs if pairs is not None else (empty, empty)
        k3, c3 = triples if triples is not None else (empty, empty)
        self.size = size = max(1, len(uni.states))
        self.word_keys = uni.hashes[uni.states]
        self.frequent = uni.hashes
        with np.errstate(divide="ignore"):
            self.word_logp = np.log10(np.where(uni.counts > 0, uni.known(uni.counts), uni.unknown)
                                      if uni.n else np.ones(len(uni.counts)))
        context = uni.counts[uni.states].astype(float) if len(uni.states) else np.ones(1)
        p1 = 10.0 ** self.word_logp[uni.states] if len(uni.states) else np.zeros(1)
        a, b = k2 // size, k2 % size
        p2 = (c2 - DISCOUNT) / context[a]
        self.fail1 = self._backoff(len(context), a, p2, p1[b])
        self.pair, self.arc2, self.pair_last = Lookup(k2), np.log10(p2), b
        ab, c = Lookup(k2)(k3 // size), k3 % size
        self.next3 = Lookup(k2)(k3 % (size * size))     # the pair of a triple's last words
        p3 = (c3 - DISCOUNT) / c2[ab] if len(k3) else np.zeros(0)
        self.fail2 = self._backoff(len(k2), ab, p3, p2[self.next3] if len(k3) else p3)
        self.triple, self.arc3 = Lookup(k3), np.log10(p3)

    @staticmethod
    def _backoff(n: int, state: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """log10 of the mass left at each state over that of the shorter state."""
        left = 1 - np.bincount(state, weights=high, minlength=n)
        under = 1 - np.bincount(state, weights=low, minlength=n)
        return np.log10(np.maximum(left, 1e-12) / np.maximum(under, 1e-12))

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Follow arcs, or failure arcs until one fits: the log10 weight on the
        way (without the empty state's, which holds the word itself) and the
        next state.  ``word``: state ids, -1 for other words."""
        size = self.size
        weight = np.zeros(len(state))
        nxt = word.copy()
        at = state
        two = np.flatnonzero(at >= size)
        settled = np.zeros(len(state), bool)
        if len(two):
            place = at[two] - size
            key = np.where(word[two] >= 0, self.pair.keys[place] * size + word[two], -1)
            hit = self.triple(key)
            ok = hit >= 0
            weight[two] = np.where(ok, self.arc3[hit] if len(self.arc3) else 0.0, self.fail2[place])
            if ok.any():
                nxt[two[ok]] = size + self.next3[hit[ok]]
                settled[two[ok]] = True
            at = at.copy()
            at[two] = self.pair_last[place]
        one = np.flatnonzero((at >= 0) & ~settled)
        if len(one):
            key = np.where(word[one] >= 0, at[one] * size + word[one], -1)
            hit = self.pair(key)
            ok = hit >= 0
            weight[one] += np.where(ok, self.arc2[hit] if len(self.arc2) else 0.0,
                                    self.fail1[at[one]])
            if ok.any():
                nxt[one[ok]] = size + hit[ok]
                settled[one[ok]] = True
        self.at_empty = ~settled
        return weight, nxt

    def score(self, toks: np.ndarray, offs: np.ndarray, place: np.ndarray) -> np.ndarray:
        """log10 weights per document.  ``place``: the tokens' positions among
        the frequent words, -1 for others, whose own probability is left out.

        Lanes of ``SEGMENT`` tokens walk in lockstep; a lane that starts inside
        a text first replays the two tokens before it to be in its state."""
        ids = _state_ids(self.word_keys, toks)
        lengths = np.diff(offs)
        lanes = -(-lengths // SEGMENT)
        doc = np.repeat(np.arange(len(lengths)), lanes)
        number = np.arange(len(doc)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        begin = offs[doc] + number * SEGMENT
        end = np.minimum(begin + SEGMENT, offs[doc + 1])
        own = np.where(place >= 0, self.word_logp[place] if len(self.word_logp) else 0.0, 0.0)
        order = np.argsort(begin - end, kind="stable")      # longest lanes first
        doc, begin, end, number = doc[order], begin[order], end[order], number[order]
        state = np.full(len(doc), -1, np.int64)
        total = np.zeros(len(doc))
        inner = np.flatnonzero(number > 0)
        for back in (2, 1):
            if len(inner):
                _, state[inner] = self.step(state[inner], ids[begin[inner] - back])
        live = len(doc)
        for t in range(SEGMENT):
            while live and end[live - 1] - begin[live - 1] <= t:
                live = int(np.searchsorted(-(end - begin)[:live], -t, "left"))
            if not live:
                break
            at = begin[:live] + t
            weight, state[:live] = self.step(state[:live], ids[at])
            total[:live] += weight + np.where(self.at_empty, own[at], 0.0)
        return np.bincount(doc, weights=total, minlength=len(lengths))


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          train: F.Column | None = None, order: int = 3) -> DataFrame:
    """Score every text under a model of the texts for which ``train`` holds
    (null: all).  Columns: id, train, n_tokens, n_known, train_tokens,
    base_score (add-one unigrams) and score (the automaton's)."""
    spark = docs.sparkSession
    train = F.lit(True) if train is None else F.coalesce(train, F.lit(False))
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"),
                         train.alias("train"))
    id_type = source.schema["id"].dataType.simpleString()
    size = source.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    buckets = 1 + size // BUCKET
    question = "block long, length int, bucket int, keys binary"
    asked = pa.schema([("block", pa.int64()), ("length", pa.int32()), ("bucket", pa.int32()),
                       ("keys", pa.binary())])
    answer = "block long, length int, bucket int, answer binary"

    def ask(lengths: tuple[int, ...]):
        schema = asked.append(pa.field("train", pa.binary()))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(batch.num_rows):
                    block = Block.of(batch, k, lengths[-1])
                    learn = np.repeat(batch.column("train")[k].values.to_numpy(zero_copy_only=False),
                                      np.diff(block.offs))
                    for length in lengths:
                        keys, which = block.keys[length - 1], block.which[length - 1]
                        times = np.bincount(which[learn & (which >= 0)], minlength=len(keys))
                        yield pa.RecordBatch.from_pylist(
                            list(to_buckets(batch.column("block")[k].as_py(), length, keys, buckets,
                                            train=times)), schema)

        return run

    def ask_contexts(table: pa.Table, told: pa.Table) -> pa.Table:
        block, rows = Block.of(table, 0, order), []
        said = [_answer(told, length, np.int64) for length in range(1, order + 1)]
        n, states = [x >> 1 for x in said], contexts(block, said)
        for k in range(1, order):       # contexts of k words, arcs of one more
            arcs = np.flatnonzero(said[k] & 1)
            at = block.at[k][arcs]
            context, shorter = block.which[k - 1][at], block.which[k - 1][at + 1]
            high = (n[k][arcs] - DISCOUNT) / n[k - 1][context]
            low = (own.known(n[0][shorter]) if k == 1 else
                   (n[k - 1][shorter] - DISCOUNT) / n[k - 2][block.which[k - 2][at + 1]])
            state = states[k - 1]
            rows += to_buckets(table.column("block")[0].as_py(), k, block.keys[k - 1][state], buckets,
                               **{name: np.bincount(context, weights=w, minlength=len(state))[state]
                                  for name, w in (("high", high), ("low", low))})
        return pa.Table.from_pylist(rows, asked.append(pa.field("high", pa.binary()))
                                    .append(pa.field("low", pa.binary())))

    def judge(table: pa.Table, told: pa.Table) -> pa.Table:
        block = Block.of(table, 0, order)
        said = [_answer(told, length, np.int64) for length in range(1, order + 1)]
        n, weight = [x >> 1 for x in said], [np.zeros(len(x)) for x in said[:-1]]
        for k, state in enumerate(contexts(block, said), 1):
            weight[k - 1][state] = _answer(told, -k, float)
        lengths, docs_n = np.diff(block.offs), len(block.offs) - 1
        owner, known = owners(block.offs), n[0][block.which[0]]
        base = np.log10(known + 1) - math.log10(own.n + own.v + 1)
        logp = walk(block, n, weight, own)
        per = lambda x: np.bincount(owner, weights=x, minlength=docs_n)
        return pa.table({"id": table.column("ids")[0].values, "train": table.column("train")[0].values,
                         "n_tokens": lengths, "n_known": per(known > 0).astype(np.int64),
                         "base_score": per(base), "score": per(logp)})

    with released(spark):
        blocks = stored(in_blocks(source), "lm-blocks")
        # in two writes, so that the shuffles are not on disk at once
        parts = [stored(blocks.mapInArrow(ask(lengths), f"{question}, train binary").groupBy("length", "bucket")
                        .applyInArrow(count, f"{answer}, n long, v long, n1 long, n2 long"), "lm-counts")
                 for lengths in ((1, 2)[:order], (3,) if order > 2 else ()) if lengths]
        counts = reduce(DataFrame.union, parts)
        own = totals(counts)
        told = counts.select("block", "length", "bucket", "answer")
        if order > 1:
            fails = stored(
                blocks.groupBy("block").cogroup(told.groupBy("block"))
                .applyInArrow(ask_contexts, f"{question}, high binary, low binary")
                .groupBy("length", "bucket").applyInArrow(fail, answer), "lm-fails")
            told = told.union(fails.withColumn("length", -F.col("length")))
    return blocks.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(
        judge, f"id {id_type}, train boolean, n_tokens long, n_known long, base_score double, "
               "score double").select(
        F.col("id").alias(id_col), "train", "n_tokens", "n_known",
        F.lit(own.n).cast("long").alias("train_tokens"), "base_score", "score")
