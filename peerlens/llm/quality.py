"""Quality classifier: logistic regression over hashed word n-grams, trained
with follow-the-regularised-leader updates, scored as sparse dot products.

Tokens are runs of letters and digits and runs of other visible characters,
in the text's own case; a token that repeats the one before it becomes one
repeat token.  Single tokens and pairs are hashed into ``BUCKETS`` weights;
a text's features are their shares of the text, so length alone says nothing.

The model is fitted on at most ``TRAIN_ROWS`` labelled texts, those with the
smallest id hash: tasks make their sparse rows, one task applies the updates
in turn, the driver gets only the weights.  Scoring covers every text whole.

Cases: a null or empty text has no feature and gets the score of the bias; a
null id is scored but never trained on; of repeated labels of an id the
smallest counts; null labels are no labels; without labels every score is
0.5; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peerlens.llm.text import _buffers, _hash_spans, chunks, mix, owners

BUCKETS = 1 << 18
TRAIN_ROWS = 6000
EPOCHS, ALPHA, BETA, L1, L2 = 4, 0.5, 1.0, 1e-4, 1e-5
THRESHOLD = 0.7
SCALE = 8.0             # a feature's value is SCALE times its share of the text

_REPEAT = np.uint64(0x5DEECE66D1234567)
#: Classes of bytes: 0 white space and control, 1 letters, digits and bytes of
#: other scripts, 2 the rest.
_CLASS = np.full(256, 2, np.int8)
_CLASS[:33] = 0
_CLASS[127] = 0
_CLASS[48:58] = _CLASS[65:91] = _CLASS[97:123] = _CLASS[128:] = 1


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows of a string column: bucket and value of every feature (the
    n-grams as they come, repeats not merged), and document offsets."""
    data, offs = _buffers(column)
    if len(data) == 0:
        return np.zeros(0, np.int64), np.zeros(0), np.zeros(len(offs), np.int64)
    kind = _CLASS[data]
    edge = np.empty(len(data), bool)
    edge[0] = True
    edge[1:] = kind[1:] != kind[:-1]
    edge[offs[offs < len(data)]] = True
    starts = np.flatnonzero(edge)
    ends = np.r_[starts[1:], len(data)]
    solid = kind[starts] > 0
    starts, ends = starts[solid], ends[solid]
    first = np.searchsorted(starts, offs)
    hashes = _hash_spans(data, starts, ends)
    # upper-case runs differ from lower-case ones, though letters hash alike
    upper = (data[starts] >= 65) & (data[starts] <= 90) & (data[ends - 1] >= 65) & (data[ends - 1] <= 90)
    hashes = np.where(upper, ~hashes, hashes)
    owner = owners(first)
    same = np.zeros(len(hashes), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    hashes[same] = _REPEAT
    pair = np.flatnonzero(owner[1:] == owner[:-1])
    both = mix(hashes[pair] * np.uint64(3) + hashes[pair + 1] * np.uint64(0x9E3779B97F4A7C15))
    n = np.diff(first)
    buckets = np.empty(len(hashes) + len(pair), np.int64)
    buckets[_places(first, single=True)] = (hashes % np.uint64(BUCKETS)).astype(np.int64)
    buckets[_places(first, single=False)] = (both % np.uint64(BUCKETS)).astype(np.int64)
    total = n + np.maximum(n - 1, 0)
    bounds = np.concatenate([[0], np.cumsum(total)])
    values = np.repeat(SCALE / np.maximum(total, 1), total)
    return buckets, values, bounds


def _places(first: np.ndarray, single: bool) -> np.ndarray:
    """Where the tokens (or pairs) of documents go: tokens first, pairs after."""
    n = np.diff(first)
    pairs = np.maximum(n - 1, 0)
    start = np.concatenate([[0], np.cumsum(n + pairs)])[:-1]
    count, base = (n, start) if single else (pairs, start + n)
    within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return np.repeat(base, count) + within


class Ftrl:
    """FTRL-proximal logistic regression on sparse rows."""

    def __init__(self, buckets: int = BUCKETS):
        self.z, self.n = np.zeros(buckets), np.zeros(buckets)
        self.bias_z = self.bias_n = 0.0

    def _weights(self, z, n):
        shrunk = np.sign(z) * np.maximum(np.abs(z) - L1, 0)
        return -shrunk / ((BETA + np.sqrt(n)) / ALPHA + L2)

    def _bias(self) -> float:
        return -self.bias_z / ((BETA + self.bias_n ** 0.5) / ALPHA)

    def update(self, at: np.ndarray, x: np.ndarray, y: float) -> None:
        """One example: distinct buckets with their values, label 0 or 1."""
        w, b = self._weights(self.z[at], self.n[at]), self._bias()
        p = 1 / (1 + np.exp(-np.clip(w @ x + b, -35, 35)))
        g = (p - y) * x
        new = self.n[at] + g * g
        self.z[at] += g - (np.sqrt(new) - np.sqrt(self.n[at])) / ALPHA * w
        self.n[at] = new
        gb = p - y
        nb = self.bias_n + gb * gb
        self.bias_z += gb - (nb ** 0.5 - self.bias_n ** 0.5) / ALPHA * b
        self.bias_n = nb

    def model(self) -> tuple[np.ndarray, float]:
        return self._weights(self.z, self.n), float(self._bias())


def sparse(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and their values."""
    buckets, values, _ = features(pa.array([text], pa.string()))
    at, inverse = np.unique(buckets, return_inverse=True)
    x = np.bincount(inverse, weights=values, minlength=len(at))
    return at.astype(np.int32), x.astype(np.float32)


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]]) -> tuple[np.ndarray, float]:
    """Weights and bias from (buckets, values, label) rows, shuffled each epoch."""
    learner = Ftrl()
    order = np.random.default_rng(9)
    for _ in range(EPOCHS):
        for k in order.permutation(len(rows)):
            at, x, y = rows[k]
            learner.update(at, x.astype(float), y)
    return learner.model()


def scores(model: tuple[np.ndarray, float], column: pa.Array) -> np.ndarray:
    """Probability of label 1 of every text: a sparse dot product each."""
    weights, bias = model
    buckets, values, bounds = features(column)
    terms = np.concatenate([[0.0], np.cumsum(weights[buckets] * values)])
    return 1 / (1 + np.exp(-np.clip(terms[bounds[1:]] - terms[bounds[:-1]] + bias, -35, 35)))


def labelled(docs: DataFrame, labels: DataFrame, use: F.Column, label_col: str = "quality",
             id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, y): at most ``TRAIN_ROWS`` labelled texts of ids for which
    ``use`` holds."""
    usable = (labels.where(use & F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1))
              .groupBy(id_col).agg(F.min(label_col).cast("int").alias("y")))
    picked = F.broadcast(usable.orderBy(F.xxhash64(id_col), id_col).limit(TRAIN_ROWS))
    return (docs.select(id_col, text_col).join(picked, id_col)
            .groupBy(F.col(id_col).cast("string").alias("id")).agg(
                F.min(F.coalesce(F.col(text_col), F.lit(""))).alias("text"), F.first("y").alias("y")))


def train(docs: DataFrame, labels: DataFrame, use: F.Column, **columns):
    """A broadcast model (``BUCKETS`` weights)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                made = [sparse(t or "") for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("y"),
                     pa.array([at.tobytes() for at, _ in made], pa.binary()),
                     pa.array([x.tobytes() for _, x in made], pa.binary())],
                    names=["id", "y", "buckets", "x"])

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(r["id"], np.frombuffer(r["buckets"], np.int32), np.frombuffer(r["x"], np.float32),
                 r["y"]) for batch in batches for r in batch.to_pylist()]
        held.sort(key=lambda r: r[0])
        weights, bias = fit([r[1:] for r in held])
        yield pa.RecordBatch.from_arrays([pa.array([weights.tobytes()], pa.binary()),
                                          pa.array([bias])], names=["weights", "bias"])

    # TRAIN_ROWS rows in the one task: the updates follow each other
    row = (labelled(docs, labels, use, **columns)
           .mapInArrow(rows, "id string, y int, buckets binary, x binary").repartition(1)
           .mapInArrow(fitted, "weights binary, bias double").first())
    model = (np.frombuffer(row["weights"]), row["bias"]) if row else Ftrl().model()
    return docs.sparkSession.sparkContext.broadcast(model)


def score(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and score (0 to 1) of every text."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = source.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(scores(model.value, part.column("text")))],
                    names=["id", "score"])

    return source.mapInArrow(run, f"id {id_type}, score double").withColumnRenamed("id", id_col)


def keep(docs: DataFrame, model, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The documents whose score reaches ``threshold``, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, text_col):
                good = scores(model.value, part.column(part.schema.get_field_index(text_col)))
                yield part.filter(pa.array(good >= threshold))

    return docs.mapInArrow(run, docs.schema)
