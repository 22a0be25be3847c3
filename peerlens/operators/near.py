"""Nearest rows within groups: the step that all twins share.

Candidates and queries that meet share a group (a cell of a pool, or a chunk of
a label).  Spark deals every group in blocks of at most ``BLOCK_QUERIES``
queries; a task scores its block with array operations.  It orders the group's
candidates in boxes of at most ``BOX_ROWS`` rows, takes the best score that a
query finds in its nearest box as a bound, and looks only into boxes that can
hold a better row: box by box for a few features, where boxes prune, else for
runs of neighbouring queries.  Bounds come from rounded products with a margin;
the scores themselves are summed feature by feature, as the SQL does.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

BLOCK_QUERIES = 8192
BOX_ROWS = 256
RUN = 256                   # queries of one neighbourhood, scored at once
ROOM = 4_000_000            # pairs held at once
FEW = 16                    # features up to which queries go from box to box
NEAR = 4                    # boxes whose rows bound a query's search
SLICE = 8192                # queries whose distances to all boxes are held at once


def _radius2(d2: np.ndarray, m: np.ndarray) -> np.ndarray:
    """``_reach`` of the score at a squared distance."""
    with np.errstate(divide="ignore", invalid="ignore"):
        n = np.rint(np.exp(-d2 / (4.0 * m)) * 1e4)
        r2 = -4.0 * m * np.log((n - 0.5) / 1e4) * (1 + 1e-9) + 1e-9
    return np.where(n >= 1, r2, np.inf)


def _reach(score: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The squared distance within which a score (0 to 100) of at least ``score``
    lies, with a margin; infinite where every distance can have it."""
    n = np.rint(score * 100.0)
    with np.errstate(divide="ignore", invalid="ignore"):
        r2 = -4.0 * m * np.log((n - 0.5) / 1e4) * (1 + 1e-9) + 1e-9
    return np.where(n >= 1, r2, np.inf)


def _boxes(x: np.ndarray) -> list[np.ndarray]:
    """Positions of the rows, halved along the widest side down to BOX_ROWS."""
    todo, out = [np.arange(len(x))], []
    while todo:
        p = todo.pop()
        if len(p) <= BOX_ROWS:
            out.append(p)
            continue
        d = np.ptp(x[p], axis=0).argmax()
        half = len(p) // 2
        p = p[np.argpartition(x[p, d], half)]
        todo += [p[half:], p[:half]]
    return out


def _score(x: np.ndarray, c: np.ndarray, qx: np.ndarray, k: np.ndarray, m: np.ndarray,
           q: np.ndarray) -> np.ndarray:
    """``twins._score`` of queries ``q`` with rows ``c``, in the same order of operations."""
    d2 = np.zeros(len(c))
    for j in range(x.shape[1]):
        diff = x[c, j] - qx[q, j]
        d2 = d2 + k[q, j] * diff * diff
    return np.rint(np.exp(-(1.0 / (4.0 * m[q])) * d2) * 100.0 * 100.0) / 100.0


def best(x: np.ndarray, place: np.ndarray, qx: np.ndarray, k: np.ndarray, m: np.ndarray,
         limit: np.ndarray, top: np.ndarray, allowed) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of every query's ``top`` best rows within ``limit``,
    the squared distance known to hold them: scores downwards, then ``place``.
    ``allowed(q, c)`` tells which pairs count."""
    most = int(top.max())
    finite = bool(np.isfinite(x).all() and np.isfinite(qx).all() and np.isfinite(k).all())
    if finite and x.shape[1] <= FEW and len(x) > BOX_ROWS:
        return _by_box(x, place, qx, k, m, limit, top, allowed)
    return _by_run(x, place, qx, k, m, limit, top, allowed, finite)


def _gaps(y: np.ndarray, k: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The squared distances of queries from boxes."""
    out = np.zeros((len(y), len(low)), y.dtype)
    step = max(1, (1 << 17) // max(1, len(low)))
    one = bool((k == 1).all())
    for i in range(0, len(y), step):
        part = out[i:i + step]
        for j in range(y.shape[1]):
            at = y[i:i + step, j, None]
            side = np.maximum(low[None, :, j] - at, at - high[None, :, j])
            np.maximum(side, 0, out=side)
            side *= side
            if not one:
                side *= k[i:i + step, j, None]
            part += side
    return out


def _by_box(x, place, qx, k, m, limit, top, allowed):
    """``best`` for few features: every box meets the queries that it can serve."""
    most = int(top.max())
    unit = np.where(k[0] > 0, np.sqrt(k[0]), 1.0)
    centre = x.mean(0)
    z, ratio = (x - centre) * unit, k / (unit * unit)
    one = bool((ratio == 1).all())          # the pool's own factors, as a rule
    reach = max(np.abs(z).max(), np.abs((qx - centre) * unit).max()) ** 2 * max(1.0, ratio.max())
    # rounded products bound a distance to ``slack`` of the two squared lengths
    kind, slack = (np.float32, 1e-5) if reach < 1e15 else (np.float64, 1e-12)
    boxes = _boxes(z)
    order, ends = np.concatenate(boxes), np.cumsum([0] + [len(b) for b in boxes])
    low = np.array([z[b].min(0) for b in boxes]).astype(kind)
    high = np.array([z[b].max(0) for b in boxes]).astype(kind)
    z = z[order]
    right = np.hstack([z, (z * z).sum(1)[:, None] if one else z * z, np.ones((len(z), 1))]).astype(kind)
    found, wide = [], []

    def served(b_of, q_of):
        """(box, its queries) of pairs ordered by box."""
        cuts = np.searchsorted(b_of, np.arange(len(boxes) + 1))
        for b in np.flatnonzero(np.diff(cuts)):
            yield b, slice(cuts[b], cuts[b + 1]), q_of[cuts[b]:cuts[b + 1]]

    for i in range(0, len(qx), SLICE):
        part = np.arange(i, min(len(qx), i + SLICE))
        y, kq, within = (qx[part] - centre) * unit, ratio[part], limit[part].copy()
        own = (kq * y * y).sum(1)
        left = np.hstack([-2 * kq * y, np.ones((len(part), 1)) if one else kq, own[:, None]]).astype(kind)
        gap = _gaps(y.astype(kind), kq.astype(kind), low, high)
        if not np.isfinite(within).all():   # the best of the nearest boxes bound the search
            near = min(NEAR, len(boxes))
            b_of = np.argpartition(gap, near - 1, axis=1)[:, :near].ravel()
            by = np.argsort(b_of, kind="stable")
            least = np.full((len(b_of), most), np.inf)
            for b, at, pair in served(b_of[by], by):
                q, c = pair // near, order[ends[b]:ends[b + 1]]
                d2 = left[q] @ right[ends[b]:ends[b + 1]].T
                d2[~np.broadcast_to(allowed(part[q][:, None], c[None, :]), d2.shape)] = np.inf
                n = min(most, len(c))
                least[pair, :n] = np.partition(d2, n - 1, axis=1)[:, :n]
            far = np.partition(least.reshape(len(part), -1), most - 1, axis=1)[:, most - 1]
            far += slack * (own + np.abs(far)) + 1e-9
            within = np.minimum(within, np.where(np.isfinite(far), _radius2(far, m[part]), np.inf))
        bounded = np.isfinite(within)
        wide.append(part[~bounded])
        bound = np.where(bounded, within * (1 + 1e-9) + slack * (own + within) + 1e-9, -1.0)
        hit = np.flatnonzero(np.ascontiguousarray((gap <= bound[:, None]).T))
        b_of, q_of = hit // len(part), hit % len(part)
        held, rows = 0, []

        def keep():
            a, c = (np.concatenate(p) for p in zip(*rows))
            ok = allowed(a, c)
            a, c = a[ok], c[ok]
            return _first(a, c, _score(x, c, qx, k, m, a), place, top)

        for b, _, q in served(b_of, q_of):
            d2 = left[q] @ right[ends[b]:ends[b + 1]].T
            hit = np.flatnonzero(d2 <= bound[q, None])
            a = hit // d2.shape[1]
            rows.append((part[q[a]], order[ends[b] + hit - a * d2.shape[1]]))
            held += len(hit)
            if held > ROOM:
                a, c, _ = keep()
                held, rows = 0, [(a, c)]
        if rows:
            found.append(keep())
    wide = np.concatenate(wide)
    if len(wide):                           # too few rows near them to bound the search
        a, c, s = _by_run(x, place, qx[wide], k[wide], m[wide], limit[wide], top[wide],
                          lambda q, c: allowed(wide[q], c), True)
        found.append((wide[a], c, s))
    if not found:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    return tuple(np.concatenate(p) for p in zip(*found))


def _by_run(x, place, qx, k, m, limit, top, allowed, finite):
    """``best`` for many features, or values that are no numbers."""
    most = int(top.max())
    boxes = _boxes(x * np.sqrt(k.mean(0))) if finite else [np.arange(len(x))]
    low = np.array([x[b].min(0) for b in boxes])
    high = np.array([x[b].max(0) for b in boxes])
    gap = np.zeros((len(qx), len(boxes)))
    if finite:
        for j in range(x.shape[1]):
            side = np.maximum(low[None, :, j] - qx[:, j, None], qx[:, j, None] - high[None, :, j])
            gap += k[:, j, None] * np.maximum(side, 0.0) ** 2
        gap *= 1 - 1e-9                    # its sum may round above a pair's
    home = gap.argmin(1)
    found = []
    order = np.argsort(home, kind="stable")
    for i in range(0, len(order), RUN):
        q = order[i:i + RUN]
        centre, kq, mq, within = qx[q].mean(0), k[q], m[q], limit[q]
        y = qx[q] - centre
        own = (kq * y * y).sum(1)
        left = np.hstack([kq, -2 * kq * y, own[:, None]])

        def about(c: np.ndarray) -> np.ndarray:
            z = x[c] - centre
            return left @ np.hstack([z * z, z, np.ones((len(c), 1))]).T

        def bound(d2: np.ndarray, counts: np.ndarray) -> np.ndarray:
            """``within``, lowered by the best of these pairs."""
            if d2.shape[1] < most:
                return within
            far = np.partition(np.where(counts, d2, np.inf), most - 1, axis=1)[:, most - 1]
            return np.minimum(within, _radius2(far + 1e-9 + 1e-12 * (own + np.abs(far)), mq))

        if finite:
            near = np.concatenate([boxes[b] for b in np.unique(home[q])])
            step = max(most, ROOM // len(q))
            for c in (near[j:j + step] for j in range(0, len(near), step)):
                within = bound(about(c), allowed(q[:, None], c[None, :]))
        see = np.flatnonzero((gap[q] <= within[:, None]).any(0))
        if not len(see):
            continue
        wide = np.concatenate([boxes[b] for b in see])
        step = max(1, ROOM // len(q))
        rows = []
        for c in (wide[j:j + step] for j in range(0, len(wide), step)):
            if finite:
                d2 = about(c)
                margin = 1e-9 + 1e-12 * own
                hit = d2 <= (within * (1 + 1e-12) + margin)[:, None]
                if hit.sum() > 16 * most * len(q):
                    within = bound(d2, allowed(q[:, None], c[None, :]))
                    hit = d2 <= (within * (1 + 1e-12) + margin)[:, None]
            else:
                hit = np.ones((len(q), len(c)), bool)
            a, b = np.nonzero(hit)
            a, b = q[a], c[b]
            ok = allowed(a, b)
            a, b = a[ok], b[ok]
            rows.append(_first(a, b, _score(x, b, qx, k, m, a), place, top))
        a, b, s = (np.concatenate(p) for p in zip(*rows))
        found.append(_first(a, b, s, place, top))
    if not found:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    return tuple(np.concatenate(p) for p in zip(*found))


def _first(q, c, score, place, top):
    """The ``top`` best rows of every query (a score that is no number first, as
    Spark sorts it)."""
    by = np.lexsort((place[c], -np.where(np.isnan(score), np.inf, score), q))
    q, c, score = q[by], c[by], score[by]
    keep = np.arange(len(q)) - np.searchsorted(q, q) < top[q]
    return q[keep], c[keep], score[keep]


def matrix(t: pa.Table | pa.RecordBatch, name: str) -> np.ndarray:
    flat = t.column(name)
    flat = (flat.combine_chunks() if isinstance(flat, pa.ChunkedArray) else flat).flatten()
    return np.asarray(flat, dtype=float).reshape(t.num_rows, -1)


def _rule(data: pa.Table, asked: pa.Table, place: np.ndarray, own: np.ndarray):
    """Which pairs count: not the query's own key, and within its filters."""
    oldest = asked.column("max_age").to_pandas().to_numpy(float)
    age = data.column("_cage").to_pandas().to_numpy(float)
    sets = [frozenset(s) if s else None for s in asked.column("selected_leagues").to_pylist()]
    which, kinds = pd.factorize(np.array(sets, object), use_na_sentinel=False)
    names, known = pd.factorize(data.column("_clg").to_pandas().to_numpy(object))
    table = np.array([[s is None or pd.isna(s) or n in s for n in known] + [s is None or pd.isna(s)]
                      for s in [None if isinstance(s, float) else s for s in kinds]], bool)
    if np.isnan(oldest).all() and table.all():
        return lambda q, c: place[c] != own[q]
    return lambda q, c: ((place[c] != own[q]) & (np.isnan(oldest[q]) | (age[c] <= oldest[q]))
                         & table[which[q], names[c]])


def group_top(cands: DataFrame, queries: DataFrame, keys: list[str],
              block: int = BLOCK_QUERIES, onward=None) -> DataFrame:
    """(_q, _ck, similarity_score): each query's ``top_n`` best candidates of its
    group.  ``cands``: ``keys``, _ck, _cage, _clg, x; ``queries``: ``keys``, _q,
    _rk, top_n, max_age, selected_leagues, m, qx, k and r2 (the squared distance
    known to hold its best, or null).

    With ``onward`` the result has a row per query instead: its columns, r2 from
    its k-th best score (null with fewer than k rows), ``found`` (the rows found)
    and ``to``, what ``onward(asked, r2)`` lists for it."""
    parts = int(cands.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sizes = queries.groupBy(*keys).agg(
        F.ceil(F.count(F.lit(1)) / F.lit(float(block))).cast("int").alias("nb"))
    left = (cands.join(sizes, keys)
            .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).drop("nb")
            .repartition(parts, *keys, "block"))
    right = (queries.join(sizes, keys)
             .withColumn("block", F.pmod(F.xxhash64("_q"), F.col("nb")).cast("int")).drop("nb")
             .repartition(parts, *keys, "block"))
    key_type = cands.schema["_ck"].dataType
    schema = f"_q long, _ck {key_type.simpleString()}, similarity_score double"
    own = [c for c in queries.columns if c != "r2"]
    if onward:
        schema = StructType([queries.schema[c] for c in own] + [
            StructField("r2", DoubleType()),
            StructField("found", ArrayType(StructType([
                StructField("_ck", key_type), StructField("similarity_score", DoubleType())]))),
            StructField("to", ArrayType(StringType()))])

    def search(data: pa.Table, asked: pa.Table):
        n = data.num_rows
        if not (n and asked.num_rows):
            return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
        both = np.concatenate([data.column("_ck").to_pandas().to_numpy(),
                               asked.column("_rk").to_pandas().to_numpy()])
        place = pd.factorize(both, sort=True)[0]
        limit = asked.column("r2").to_pandas().to_numpy(float)
        return best(matrix(data, "x"), place[:n], matrix(asked, "qx"), matrix(asked, "k"),
                    asked.column("m").to_numpy().astype(float),
                    np.where(np.isnan(limit), np.inf, limit),
                    asked.column("top_n").to_numpy().astype(int),
                    _rule(data, asked, place[:n], place[n:]))

    def solve(data: pa.Table, asked: pa.Table) -> pa.Table:
        q, c, s = search(data, asked)
        return pa.table({"_q": asked.column("_q").take(pa.array(q)),
                         "_ck": data.column("_ck").take(pa.array(c)),
                         "similarity_score": pa.array(s, pa.float64())})

    def solve_rows(data: pa.Table, asked: pa.Table) -> pa.Table:
        n = asked.num_rows
        q, c, s = search(data, asked)
        by = np.argsort(q, kind="stable")
        q, c, s = q[by], c[by], s[by]
        ends = np.searchsorted(q, np.arange(n + 1))
        pairs = pa.StructArray.from_arrays(
            [data.column("_ck").combine_chunks().take(pa.array(c)), pa.array(s, pa.float64())],
            names=["_ck", "similarity_score"])
        r2 = np.full(n, np.inf)
        if n:
            full = np.diff(ends) >= asked.column("top_n").to_numpy()
            worst = s[ends[1:][full] - 1]               # a row's scores fall
            r2[full] = _reach(worst, asked.column("m").to_numpy().astype(float)[full])
        out = {f: asked.column(f) for f in own}
        out["r2"] = pa.array(r2, mask=~np.isfinite(r2))
        out["found"] = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)
        out["to"] = onward(asked, r2)
        return pa.table(out)

    return (left.groupBy(*keys, "block").cogroup(right.groupBy(*keys, "block"))
            .applyInArrow(solve_rows if onward else solve, schema))
