"""Importance resampling towards a target: the documents most like a sample.

Features are runs of 1 to ``runs`` consecutive words, hashed into ``BUCKETS``
buckets.  The buckets' counts in all source and all target texts give an array
of gains, a smoothed log ratio each, and a document's weight is the sum of the
gains of its features.  Gumbel noise, a hash of the id, is added, and the
highest scores are drawn: sampling without replacement in proportion to the
weights, repeatable.

The cutoff is found by bisection of the score, a number: scores and ids are
stored once, and jobs over that table count exactly how many lie above a few
probes, each narrowing the range by ``PROBES`` + 1, until one score is left;
among the rows tied there the id is bisected in the same way.  Selected rows
are range-partitioned by score and id, and a rank is a row's place in its
partition plus the rows before it.  No sort sees more than the drawn rows and
no task more than a range of them.

Counting adds up each task's words in an array of ``BUCKETS`` numbers, so
frequent words are no hot keys; two such arrays and the gains go through the
driver.  Cases: a null text has no words, an id that is null counts as empty
text in the hash and as the last in ties; rows that repeat an id each take
part, and of those tied in score and id the smaller weight and then the smaller
number of features comes first; no target or source text gives gains all the
same; with fewer than ``100 / percent`` eligible rows none is drawn; an empty
table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peerlens.llm import text
from peerlens.session import stored

BUCKETS = 10_000
SEED = 2024
MIN_WORDS, PERCENT = 20, 10
SCALE = 1000
PROBES = 15                 # a job of the bisection: 4 bits
RANGE_ROWS = 1 << 18        # drawn rows in a range partition
LONG_WORD = 64              # bytes, above which a word is hashed alone
LAST = 2 ** 63 - 1
PIECE_BYTES = 256 << 10     # text bytes hashed at once: the arrays of a piece stay small

#: The table of the CRC-32 of zlib and Spark.
_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, (_CRC >> np.uint32(1)) ^ np.uint32(0xEDB88320), _CRC >> np.uint32(1))

#: A-Z as a-z.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def feed(state: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 (of the bytes so far: ``state``) after the bytes of every span."""
    out, size = ~state, ends - starts
    order = np.argsort(-size, kind="stable")
    live = np.searchsorted(-size[order], -LONG_WORD, "left")
    for k in order[:live]:
        out[k] = ~np.uint32(zlib.crc32(data[starts[k]:ends[k]].tobytes(), int(state[k])))
    order = order[live:]
    held, at, left = out[order], starts[order], size[order]
    step = 0
    while (n := int(np.searchsorted(-left, -step, "left"))):
        held[:n] = _CRC[(held[:n] ^ data[at[:n] + step]) & 0xFF] ^ (held[:n] >> np.uint32(8))
        step += 1
    out[order] = held
    return ~out


def features(column: pa.Array, runs: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For every run length: (buckets, offsets by document) of the runs of words."""
    w = text.words(column, text.MARKS)
    data = _LOWER[w.data]
    doc = text.owners(w.offsets)
    state = feed(np.zeros(len(w.starts), np.uint32), data, w.starts, w.ends)
    yield (state % BUCKETS).astype(np.int64), w.offsets
    blank = np.array([0x20], np.uint8)
    for n in range(2, runs + 1):
        heads = np.flatnonzero(doc[:max(0, len(doc) - n + 1)] == doc[n - 1:])
        grown = np.zeros(len(state), np.uint32)
        zero = np.zeros(len(heads), np.int64)
        grown[heads] = feed(feed(state[heads], blank, zero, zero + 1), data,
                            w.starts[heads + n - 1], w.ends[heads + n - 1])
        state = grown
        yield (state[heads] % BUCKETS).astype(np.int64), np.searchsorted(heads, w.offsets)


def bucket_counts(df: DataFrame, text_col: str, runs: int) -> np.ndarray:
    """How many features of all texts fall into each bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for chunk in text.chunks(batch, size=PIECE_BYTES):
                for buckets, _ in features(chunk.column("text"), runs):
                    held += np.bincount(buckets, minlength=BUCKETS)
            pa.default_memory_pool().release_unused()
        used = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(held[used])],
                                         names=["bucket", "n"])

    parts = df.select(F.col(text_col).alias("text")).mapInArrow(count, "bucket int, n long")
    table = parts.groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(BUCKETS, np.int64)
    out[table.column("bucket").to_numpy()] = table.column("n").to_numpy()
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(SCALE * ln) of the smoothed ratio of the buckets' shares."""
    S, T = int(source.sum()), int(target.sum())
    up = (target + 1.0) * (S + BUCKETS)
    return np.floor(SCALE * np.log(up / ((source + 1.0) * (T + BUCKETS)))).astype(np.int64)


def noise(id_text: Column, seed: int) -> Column:
    """floor(-SCALE * ln(-ln(u))) with u from the id's hash."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), id_text), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-float(SCALE)) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def scored(docs: DataFrame, gain: np.ndarray, runs: int, id_col: str, text_col: str,
           seed: int) -> DataFrame:
    """id, n_words, n_features, weight and score of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in text.chunks(batch, size=PIECE_BYTES):
                words = n = weight = None
                for buckets, offsets in features(chunk.column("text"), runs):
                    total = np.zeros(len(buckets) + 1, np.int64)
                    np.cumsum(shared.value[buckets], out=total[1:])
                    size, sums = np.diff(offsets), np.diff(total[offsets])
                    if words is None:
                        words, n, weight = size, size, sums
                    else:
                        n, weight = n + size, weight + sums
                yield pa.RecordBatch.from_arrays(
                    [chunk.column("id"), pa.array(words, pa.int64()), pa.array(n, pa.int64()),
                     pa.array(weight, pa.int64())], names=["id", "n_words", "n_features", "weight"])
            pa.default_memory_pool().release_unused()

    rows = (docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
            .mapInArrow(weigh, f"id {docs.schema[id_col].dataType.simpleString()}, n_words long, "
                               "n_features long, weight long"))
    id_text = F.coalesce(F.col("id").cast("string"), F.lit(""))
    return rows.withColumn("score", F.col("weight") + noise(id_text, seed))


def kth_largest(rows: DataFrame, value: Column, k: int) -> tuple[int, int]:
    """The k-th largest of a long column and how many are larger, by counting:
    ``rows`` is stored, every job reads it once, and no row moves."""
    low, high = rows.agg(F.min(value), F.max(value)).first()     # the answer lies within both
    above = 0                                                    # rows beyond ``high``
    while low < high:
        width = high - low
        probes = sorted({low + width * i // (PROBES + 1) for i in range(1, PROBES + 1)} - {low} | {high})
        held = rows.agg(*[F.count_if(value >= F.lit(p)) for p in probes]).first()
        # the largest probe that k values reach is the new low, the next one bounds it
        reached = [i for i, n in enumerate(held) if n >= k]
        at = reached[-1] if reached else -1
        if at + 1 < len(probes):
            high, above = probes[at + 1] - 1, held[at + 1]
        low = probes[at] if at >= 0 else low
    return low, above


def draw(docs: DataFrame, target: DataFrame, runs: int = 1, percent: int = PERCENT,
         min_words: int = MIN_WORDS, seed: int = SEED, id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """Id, n_features, weight, score and rank (from 1; null: not drawn) of every
    document.  Of the N documents with ``min_words`` words or more,
    floor(``percent`` * N / 100) are drawn."""
    gain = gains(bucket_counts(docs, text_col, runs), bucket_counts(target, text_col, runs))
    rows = stored(scored(docs, gain, runs, id_col, text_col, seed), "resample-scores")
    can = F.col("n_words") >= min_words
    out = [F.col("id").alias(id_col), "n_features", "weight", "score"]
    eligible = rows.where(can)
    wanted = percent * eligible.count() // 100
    if wanted == 0:
        return rows.select(*out, F.lit(None).cast("long").alias("rank"))

    cutoff, above = kth_largest(eligible, F.col("score"), wanted)
    order_id = F.coalesce(F.col("id").cast("long"), F.lit(LAST))
    # ids ascending: the largest of the negated ones
    tied = eligible.where(F.col("score") == cutoff)
    last, _ = kth_largest(tied, -order_id, wanted - above)
    within = can & ((F.col("score") > cutoff) | ((F.col("score") == cutoff) & (-order_id >= last)))

    by = [F.desc("score"), F.asc_nulls_last("id"), F.asc("weight"), F.asc("n_features")]
    ranges = max(1, -(-wanted // RANGE_ROWS))
    chosen = stored(rows.where(within).repartitionByRange(ranges, *by)
                    .withColumn("range", F.spark_partition_id()), "resample-drawn")
    # a row per range partition
    sizes = sorted((r["range"], r["count"]) for r in chosen.groupBy("range").count().collect())
    before = np.cumsum([0] + [n for _, n in sizes]).tolist()
    offsets = docs.sparkSession.createDataFrame(
        [(p, n) for (p, _), n in zip(sizes, before)], "range int, before long")
    place = F.row_number().over(Window.partitionBy("range").orderBy(*by)) + F.col("before")
    chosen = chosen.join(F.broadcast(offsets), "range")
    ranked = chosen.withColumn("rank", place.cast("long")).withColumn(
        "rank", F.when(F.col("rank") <= wanted, F.col("rank")))      # repeats of the last id
    rest = rows.where(~within).withColumn("rank", F.lit(None).cast("long"))
    return ranked.select(*out, "rank").unionByName(rest.select(*out, "rank"))
