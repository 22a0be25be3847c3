"""Exact top-k search by inner product: a Voronoi join of queries and data.

Components become integers, floor(``SCALE`` * x), so scores are exact.  A
bounded set of pivots, real data rows, cuts the data into Voronoi cells; one
aggregate summarises a cell by its rows and its radius r.  For a query q and
a cell with pivot p all scores lie in q.p -+ |q| r, so the summaries, and q's
scores with the pivots themselves, give a value that at least k rows reach;
a cell whose upper bound stays below it is never sent to q.  Queries of one
neighbourhood form blocks of at most ``QUERY_ROWS``; a cell is replicated only
to the blocks with a query that needs it, dealt in chunks of about
``DATA_ROWS``, solved there, and the few local winners are merged per query.

Equal vectors collapse to their k + 1 smallest ids before all this, which no
result can miss, so a vector that a third of the rows share is no hot cell.

Cases: vectors that are null or hold null or non-finite components, and rows
without an id, take no part; shorter vectors count as padded with zeros, and
an empty vector scores 0; ties go to the smaller id; rows that repeat an id
and its vector count once, and no row with the query's id is its result;
with fewer than k candidates all are returned; an empty table gives an empty
one; other columns are ignored.  Integer components are exact below 2^62 and
kept within that size; scores are exact and kept within a long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from peerlens.session import stored

SCALE = 1024.0
PIVOTS = 256            # at most: sqrt of the rows, rounded up, below that
QUERY_ROWS, DATA_ROWS = 512, 2048
MAX_COMPONENT = float(1 << 62)


def integer_vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) of the rows that take part: ``v`` holds 64-bit integers without
    trailing zeros, little-endian."""
    source = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = [], []
            for i, row in zip(batch.column("id").to_pylist(), batch.column("x")):
                if i is None or not row.is_valid:
                    continue
                values = row.values
                if values.null_count:
                    continue
                x = np.asarray(values.cast(pa.float64()))
                if not np.isfinite(x).all():
                    continue
                with np.errstate(over="ignore"):
                    v = np.clip(np.floor(SCALE * x), -MAX_COMPONENT, MAX_COMPONENT).astype("<i8")
                used = np.flatnonzero(v)
                ids.append(i)
                out.append(v[:used[-1] + 1 if len(used) else 0].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())],
                                             names=["id", "v"])

    return source.mapInArrow(run, "id long, v binary")


def matrix(rows: list[bytes], width: int | None = None) -> np.ndarray:
    """Integer vectors as rows of one matrix, padded with zeros."""
    width = max([len(r) // 8 for r in rows], default=0) if width is None else width
    out = np.zeros((len(rows), width), np.int64)
    for k, r in enumerate(rows):
        v = np.frombuffer(r, "<i8")[:width]
        out[k, :len(v)] = v
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of all rows of ``a`` with all rows of ``b``
    (beyond a long: the nearest long)."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if top < 2.0 ** 53:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    exact = a.astype(object) @ b.astype(object).T
    return np.clip(exact, -2**63, 2**63 - 1).astype(np.int64)


def norms(a: np.ndarray) -> np.ndarray:
    return np.sqrt((a.astype(float) ** 2).sum(1))


class Cells:
    """The pivots, and the summary of every cell once it is known."""

    def __init__(self, ids: list[int], rows: list[bytes]):
        self.ids, self.points = np.array(ids, np.int64), matrix(rows)
        self.rows = self.radius = np.zeros(0)

    def _fit(self, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Both matrices with the same width."""
        p = self.points
        width = max(a.shape[1], p.shape[1])
        pad = lambda m: np.pad(m, ((0, 0), (0, width - m.shape[1])))
        return pad(a).astype(float), pad(p).astype(float)

    def nearest(self, a: np.ndarray, among: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Cell and distance of every row (of the first ``among`` cells)."""
        a, p = self._fit(a)
        p = p[:among]
        d2 = (a ** 2).sum(1)[:, None] - 2 * (a @ p.T) + (p ** 2).sum(1)
        cell = d2.argmin(1)
        return cell, np.sqrt(((a - p[cell]) ** 2).sum(1))

    def needed(self, ids: np.ndarray, q: np.ndarray, k: int) -> np.ndarray:
        """Which cells may hold one of a query's k best rows."""
        q, p = self._fit(q)
        dot, reach = q @ p.T, norms(q)[:, None] * self.radius
        # rounding, of products whose terms may cancel too
        slack = 1e-6 * (1 + np.abs(dot)) + 1e-12 * norms(q)[:, None] * norms(p)[None, :]
        reach = reach * (1 + 1e-9) + slack
        low, high = dot - reach, dot + reach
        # from the summaries: the cells with the highest lower bounds hold k + 1 rows
        order = np.argsort(-low, axis=1, kind="stable")
        held = np.cumsum(self.rows[order], axis=1)
        at = (held < k + 1).sum(1)
        enough = at < held.shape[1]
        floor_ = np.full(len(q), -np.inf)
        rows = np.flatnonzero(enough)
        floor_[rows] = low[rows, order[rows, at[rows]]]
        # from the pivots, which are rows: the k-th best of the others
        if p.shape[0] > k:
            others = np.where(self.ids[None, :] == ids[:, None], -np.inf, dot)
            kth = -np.partition(-others, k - 1, axis=1)[:, k - 1]
            floor_ = np.maximum(floor_, kth - 1e-6 * (1 + np.abs(kth)) - slack.max(1))
        return (high >= floor_[:, None]) & (self.rows > 0)


def best(ids: np.ndarray, data: np.ndarray, qids: np.ndarray, queries: np.ndarray, k: int):
    """(query position, data position, score) of every query's k best rows,
    ties to the smaller id."""
    order = np.argsort(ids, kind="stable")
    score = products(queries, data[order])
    valid = qids[:, None] != ids[order][None, :]
    masked = np.where(valid, score, np.iinfo(np.int64).min)
    if masked.shape[1] > k:
        kth = np.partition(masked, masked.shape[1] - k, axis=1)[:, -k]
        valid &= masked >= kth[:, None]
    q, d = np.nonzero(valid)
    s = score[q, d]
    by = np.lexsort((d, -s, q)) if not len(s) or s.min() > np.iinfo(np.int64).min else np.lexsort(
        (d, np.invert(s), q))
    q, d, s = q[by], d[by], s[by]
    first = np.searchsorted(q, np.arange(len(qids)))
    near = np.arange(len(q)) - first[q] < k
    return q[near], order[d[near]], s[near]


def topk(df: DataFrame, is_query: F.Column, k: int = 10, id_col: str = "vec_id",
         vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), the result's id and score for every row for
    whose id ``is_query`` (an expression of column ``id``) holds."""
    spark = df.sparkSession
    rows = stored(integer_vectors(df, id_col, vector_col), "topk-vectors")
    same = Window.partitionBy("v").orderBy("id")
    data = stored(rows.distinct().withColumn("n", F.row_number().over(same))
                  .where(F.col("n") <= k + 1).drop("n"), "topk-data")
    queries = rows.where(is_query).distinct()
    n, nq = data.count(), queries.count()
    if n == 0 or nq == 0:
        return spark.createDataFrame([], f"query_id long, rank int, {id_col} long, score long")

    # pivots: distinct vectors with the smallest hash, at most PIVOTS of them
    want = min(PIVOTS, int(np.ceil(np.sqrt(n))))
    picked = (data.groupBy("v").agg(F.min("id").alias("id"))
              .orderBy(F.xxhash64("v"), "id").limit(want).collect())
    cells = Cells([r["id"] for r in picked], [bytes(r["v"]) for r in picked])
    pivots = spark.sparkContext.broadcast(cells)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = matrix(batch.column("v").to_pylist())
            if len(m):
                cell, far = pivots.value.nearest(m)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), batch.column("v"), pa.array(cell.astype(np.int32)),
                     pa.array(far)], names=["id", "v", "cell", "far"])

    placed = stored(data.mapInArrow(assign, "id long, v binary, cell int, far double"), "topk-cells")
    summary = np.zeros((2, len(picked)))
    for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("r")).collect():
        summary[:, r["cell"]] = r["n"], r["r"]
    cells = Cells([r["id"] for r in picked], [bytes(r["v"]) for r in picked])
    cells.rows, cells.radius = summary
    known = spark.sparkContext.broadcast(cells)

    groups = max(1, min(len(picked), -(-nq // QUERY_ROWS)))     # query neighbourhoods
    salts = max(1, -(-nq // (groups * QUERY_ROWS)))             # blocks in each
    chunks = max(1, -(-n // DATA_ROWS))

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = matrix(batch.column("v").to_pylist())
            if len(m):
                at, _ = known.value.nearest(m, groups)
                need = known.value.needed(np.asarray(batch.column("id")), m, k)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), batch.column("v"), pa.array(at.astype(np.int32)),
                     pa.array([np.flatnonzero(x).astype(np.int32) for x in need],
                              pa.list_(pa.int32()))], names=["id", "v", "area", "cells"])

    planned = stored(queries.mapInArrow(plan, "id long, v binary, area int, cells array<int>")
                     .withColumn("block", F.col("area") * salts
                                 + F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int")), "topk-queries")
    wanted = planned.select("block", F.explode("cells").alias("cell")).distinct()
    chunk = F.pmod(F.xxhash64("id", F.lit("chunk")), F.lit(chunks)).cast("int")
    left = (placed.join(wanted, "cell")
            .select("block", chunk.alias("chunk"), "id", "v"))
    every = F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))
    right = planned.select(F.col("block").alias("to_block"), every.alias("to_chunk"),
                           F.col("id").alias("qid"), F.col("v").alias("qv"))

    def solve(data_part: pa.Table, query_part: pa.Table) -> pa.Table:
        ids, qids = (t.column(c).to_numpy() for t, c in ((data_part, "id"), (query_part, "qid")))
        raw, qraw = data_part.column("v").to_pylist(), query_part.column("qv").to_pylist()
        if not raw or not qraw:
            q = d = s = np.zeros(0, np.int64)
        else:
            width = max(len(r) // 8 for r in (*raw, *qraw))
            q, d, s = best(ids, matrix(raw, width), qids, matrix(qraw, width), k)
        return pa.table({"query_id": pa.array(qids[q], pa.int64()), "id": pa.array(ids[d], pa.int64()),
                         "score": pa.array(s, pa.int64())})

    local = (left.groupBy("block", "chunk").cogroup(right.groupBy("to_block", "to_chunk"))
             .applyInArrow(solve, "query_id long, id long, score long"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return (local.distinct().withColumn("rank", F.row_number().over(order))
            .where(F.col("rank") <= k)
            .select("query_id", "rank", F.col("id").alias(id_col), "score"))
