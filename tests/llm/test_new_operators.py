"""Nearest neighbours, vector codes and resampling against brute force, with
nulls, ties, repeated rows, empty tables and clashing column names."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from peerlens.llm import multi_index, near_dup, resample, sharding, topk, vector_codes

NAN, INF = float("nan"), float("inf")


def clustered(rng, n, width, groups=12):
    centres = rng.normal(size=(groups, width))
    return centres[rng.integers(0, groups, n)] + 0.4 * rng.normal(size=(n, width))


def cosine_rows(spark, rows, kind="double"):
    # columns named like results and helpers
    return spark.createDataFrame([(i, v, 0.5, 7) for i, v in rows],
                                 f"vec_id long, embedding array<{kind}>, score double, cell int")


def true_nearest(rows, is_query, k):
    usable = [(i, v) for i, v in rows if i is not None and v and any(v)
              and all(x is not None and math.isfinite(x) for x in v)]
    usable = [(i, list(v)) for i, v in sorted({(i, tuple(v)) for i, v in usable})]
    width = max(len(v) for _, v in usable)
    m = np.array([v + [0.0] * (width - len(v)) for _, v in usable])
    m /= np.abs(m).max(1)[:, None]
    unit = m / np.sqrt((m * m).sum(1))[:, None]
    ids = np.array([i for i, _ in usable])
    out = {}
    for q in np.flatnonzero([is_query(i) for i in ids]):
        s = unit @ unit[q]
        near = sorted((-round(float(s[j]), 12), int(ids[j])) for j in np.flatnonzero(ids != ids[q]))
        out[int(ids[q])] = near[:k]
    return out


def found_nearest(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((-round(r["score"], 12), r["vec_id"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_nearest_neighbours_recall_and_exact_scores(spark):
    rng = np.random.default_rng(3)
    rows = [(k, v.tolist()) for k, v in enumerate(clustered(rng, 3000, 12))]
    got = found_nearest(multi_index.nearest_neighbours(
        cosine_rows(spark, rows), F.col("id") % 20 == 0, k=5))
    want = true_nearest(rows, lambda i: i % 20 == 0, 5)
    assert got.keys() == want.keys()
    hits = sum(len(set(got[q]) & set(want[q])) for q in want)
    assert hits >= 0.9 * 5 * len(want)
    every = true_nearest(rows, lambda i: i % 20 == 0, len(rows))
    for q, near in got.items():                 # found rows carry their true cosines, in order
        assert set(near) <= set(every[q]) and near == sorted(near) and len(near) == 5


def test_nearest_neighbours_of_few_odd_and_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(multi_index, "TARGET", 1.0)     # every calibrated neighbour is reached
    rng = np.random.default_rng(4)
    rows = [(k, v.tolist()) for k, v in enumerate(clustered(rng, 60, 5))]
    hot = [1.0, -2.0, 0.0, 3.0, 0.5]
    rows += [(1000 + k, hot) for k in range(40)]        # a third of all rows are equal
    rows += [(2000, [2 * x for x in hot]), (2001, [1e200 * x for x in hot])]
    rows += [(3000, None), (3001, []), (3002, [0.0] * 5), (3003, [1.0, None, 2.0, 0.0, 0.0]),
             (3004, [NAN] * 5), (3005, [INF, 0.0, 0.0, 0.0, 0.0]), (None, hot), (3006, [1.0, -2.0]),
             (10, rows[10][1]), (3007, [-0.0, 1.0])]
    got = found_nearest(multi_index.nearest_neighbours(
        cosine_rows(spark, rows), F.col("id") % 2 == 0, k=5))
    want = true_nearest(rows, lambda i: i % 2 == 0, 5)
    assert got == want
    two = cosine_rows(spark, [(2, [1.0, 0.0]), (5, [0.0, 2.0])], "float")
    assert found_nearest(multi_index.nearest_neighbours(two, F.col("id") == 2)) == {2: [(0.0, 5)]}
    assert multi_index.nearest_neighbours(two.where("false"), F.col("id") >= 0).collect() == []
    assert multi_index.nearest_neighbours(two.where("vec_id = 5"), F.col("id") >= 0).collect() == []


def test_heap_pops_cells_in_order_of_summed_distance():
    rng = np.random.default_rng(5)
    index = multi_index.Index(rng.normal(size=(400, 7)), 9)
    rows = rng.normal(size=(500, 7))
    index.held += np.bincount(index.cells(rows), minlength=len(index.held))
    near = index.distances(rows[:20])
    for a, b in zip(*near):
        popped = index.pop(a, b, 500)
        sums = (a[:, None] + b[None, :]).ravel()
        assert sorted(popped) == np.flatnonzero(index.held).tolist()
        assert (np.diff(sums[popped]) >= 0).all()
        part = index.pop(a, b, 60)
        assert part == popped[:len(part)] and index.held[part].sum() >= 60 > index.held[part[:-1]].sum()
        assert index.before([a, b], np.array(part[-1:]))[0] == index.held[part].sum()


def test_posted_rows_are_split_into_tiles(spark, monkeypatch):
    monkeypatch.setattr(multi_index, "TILE_ROWS", 16)
    monkeypatch.setattr(multi_index, "QUERY_ROWS", 8)
    monkeypatch.setattr(multi_index, "TARGET", 1.0)
    monkeypatch.setattr(multi_index, "CALIBRATION", 10_000)
    rng = np.random.default_rng(6)
    crowd = 1 + 1e-3 * rng.normal(size=(300, 6))        # one crowded cell
    rows = [(k, v.tolist()) for k, v in enumerate(np.concatenate([clustered(rng, 300, 6), crowd]))]
    got = found_nearest(multi_index.nearest_neighbours(
        cosine_rows(spark, rows), F.col("id") % 10 == 0, k=4))
    assert got == true_nearest(rows, lambda i: i % 10 == 0, 4)


def test_queries_ask_in_chunks_and_copy_no_rows(spark, monkeypatch):
    """what is stored does not grow with the cells that queries pop, vectors take
    four bytes a number where that is exact, and chunks of queries lose nothing."""
    monkeypatch.setattr(multi_index, "QUERY_CHUNK", 25)
    monkeypatch.setattr(multi_index, "TILE_ROWS", 32)
    monkeypatch.setattr(multi_index, "TARGET", 1.0)
    monkeypatch.setattr(multi_index, "CALIBRATION", 10_000)
    written, stored = {}, multi_index.stored

    def noted(df, name):
        written.setdefault(name, []).append(stored(df, name))
        return written[name][-1]
    monkeypatch.setattr(multi_index, "stored", noted)
    rng = np.random.default_rng(8)
    rows = [(k, [float(np.float32(x)) for x in v]) for k, v in enumerate(clustered(rng, 500, 6))]
    rows += [(9000 + k, v.tolist()) for k, v in enumerate(clustered(rng, 100, 6))]
    got = found_nearest(multi_index.nearest_neighbours(cosine_rows(spark, rows), F.col("id") % 5 == 0, k=3))
    assert got == true_nearest(rows, lambda i: i % 5 == 0, 3)
    assert set(written) == {"ann-vectors", "ann-cells", "ann-queries", "ann-found"}
    assert len(written["ann-found"]) >= 4
    assert all("array" not in t for one in written.values() for d in one for _, t in d.dtypes)
    size = {r["id"]: len(r["v"]) for r in written["ann-cells"][0].collect()}
    assert size[7] == 6 * 4 + 1 and size[9003] == 6 * 8 + 1 and len(size) == 600


def floor_int(x):
    return math.floor(Fraction(x) * 1024)


def true_codes(rows, parts=4, entries=256, rounds=4):
    kept = [(i, lab, [floor_int(x) for x in v]) for i, lab, v in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = max((len(v) for _, _, v in kept), default=0)
    size = -(-width // parts)
    kept = [(i, lab, v + [0] * (size * parts - len(v))) for i, lab, v in kept]
    by_id = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0))
    cut = lambda v, p: v[p * size:(p + 1) * size]
    books = [[cut(v, p) for _, _, v in by_id[:entries]] for p in range(parts)]

    def nearest(book, v):
        return min((sum((a - b) ** 2 for a, b in zip(v, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p, book in enumerate(books):
            held = {}
            for _, _, v in kept:
                held.setdefault(nearest(book, cut(v, p))[1], []).append(cut(v, p))
            for k, vs in held.items():
                book[k] = [sum(c) // len(vs) for c in zip(*vs)]
    best = [[nearest(books[p], cut(v, p)) for p in range(parts)] for _, _, v in kept]
    errors = [min(2 ** 63 - 1, sum(d for d, _ in b)) for b in best]
    label = Counter()
    for (_, lab, _), e in zip(kept, errors):
        label[lab] += e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, "".join(f"{k:02x}" for _, k in b), e, min(2 ** 63 - 1, label[lab]), digest)
                   for (i, lab, _), b, e in zip(kept, best, errors)), key=str)


def found_codes(spark, rows):
    df = spark.createDataFrame([(i, lab, v, "x", 3) for i, lab, v in rows],
                               "vec_id long, label int, embedding array<double>, codes string, top int")
    return sorted(((r["vec_id"], r["code"], r["error"], r["label_error"], r["codebooks_sha256"])
                   for r in vector_codes.compress(df).collect()), key=str)


def code_rows(n, width, scale=1.0, seed=7):
    rng = np.random.default_rng(seed)
    rows = [(int(k), int(rng.integers(0, 4)), (scale * v).tolist())
            for k, v in zip(rng.permutation(n), clustered(rng, n, width))]
    rows[3] = (rows[3][0], None, rows[3][2])
    rows[9] = (rows[9][0], None, rows[9][2])
    return rows


@pytest.mark.parametrize("scale", [1.0, 3e3, 1e15])     # 32-bit, 64-bit, unbounded integers
def test_vector_codes(spark, scale):
    rows = code_rows(330, 8, scale)
    assert found_codes(spark, rows) == true_codes(rows)


def test_vector_codes_of_a_batch_and_many_labels(spark, monkeypatch):
    rows = code_rows(330, 8)
    want = true_codes(rows)
    monkeypatch.setattr(vector_codes, "TABLE_BYTES", 0)
    monkeypatch.setattr(vector_codes, "LABELS", 0)
    assert found_codes(spark, rows) == want
    df = spark.range(3).selectExpr("id", "cast(null as int) label", "'a' code", "id + 1 error")
    assert {r["label_error"] for r in vector_codes.with_label_error(df).collect()} == {6}


def test_vector_codes_of_odd_rows(spark):
    rows = code_rows(20, 7)                             # fewer than the entries, a width of no 4 parts
    rows += [(50, 1, None), (51, 1, [1.0, None]), (52, 1, [NAN] * 7), (53, 1, [INF] * 7),
             (54, 1, []), (55, 2, [0.5]), (rows[0][0], rows[0][1], rows[0][2]),
             (None, 2, [0.25, -0.25, 1.0, 0.0, 0.0, -3.0, -0.0]), (56, 3, [1e300] * 2)]
    assert found_codes(spark, rows) == true_codes(rows)
    assert found_codes(spark, rows[:0]) == []
    assert found_codes(spark, [(1, 1, None)]) == []
    assert [r[1:4] for r in found_codes(spark, [(1, None, [])])] == [("00000000", 0, 0)]


def words_of(t):
    lower = (t or "").translate({k: k + 32 for k in range(65, 91)})
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower)


def runs_of(t, runs):
    w = words_of(t)
    return [" ".join(w[i:i + n]) for n in range(1, runs + 1) for i in range(len(w) - n + 1)]


def true_draw(docs, target, runs, percent, min_words):
    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    s = Counter(bucket(f) for _, t in docs for f in runs_of(t, runs))
    t_ = Counter(bucket(f) for t in target for f in runs_of(t, runs))
    S, T = sum(s.values()), sum(t_.values())
    out = []
    for i, t in docs:
        f = [bucket(x) for x in runs_of(t, runs)]
        weight = sum(math.floor(1000 * math.log((t_[b] + 1) * (S + 10_000) / ((s[b] + 1) * (T + 10_000))))
                     for b in f)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(f), weight, score, len(words_of(t)) >= min_words])
    can = sorted((r for r in out if r[4]),
                 key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[2], r[1]))
    rank = {id(r): k for k, r in enumerate(can[:percent * len(can) // 100], 1)}
    return sorted(((*r[:4], rank.get(id(r))) for r in out), key=str)


def found_draw(spark, docs, target, **kw):
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in docs],
                               "doc_id long, text string, score int, rank int")
    to = spark.createDataFrame([(t, "x") for t in target], "text string, doc_id string")
    return sorted((tuple(r[c] for c in ("doc_id", "n_features", "weight", "score", "rank"))
                   for r in resample.draw(df, to, **kw).collect()), key=str)


def draw_docs(seed=8, n=300):
    rng = np.random.default_rng(seed)
    vocab = ["".join(rng.choice(list("abdeinorstu"), rng.integers(1, 9))) for _ in range(300)]
    vocab += ["Grün", "ÉTÉ", "日本語", "x" * 200, "a1b2"]
    docs = []
    for k in range(n):
        w = rng.choice(vocab, rng.integers(0, 60))
        docs.append((k, rng.choice([" ", ", ", "\n", "_", "\x7f"]).join(w)))
    docs[5], docs[6], docs[7] = (5, None), (6, ""), (7, " -- ")
    docs[8] = (8, " ".join(rng.choice(vocab, 30_000)))
    docs += [(11, docs[11][1]), (11, docs[12][1]), (None, docs[20][1]), (None, docs[21][1])]
    return docs, [" ".join(rng.choice(vocab[:60], 40)) for _ in range(30)] + [None, ""]


@pytest.mark.parametrize("runs,percent,min_words", [(1, 10, 20), (3, 50, 5), (2, 100, 0)])
def test_resampling(spark, runs, percent, min_words, monkeypatch):
    docs, target = draw_docs()
    monkeypatch.setattr(resample, "RANGE_ROWS", 16)     # several ranges
    got = found_draw(spark, docs, target, runs=runs, percent=percent, min_words=min_words)
    assert got == true_draw(docs, target, runs, percent, min_words)


def test_resampling_ties_and_small_tables(spark, monkeypatch):
    # every score is the same: the id decides, and copies of one id share the places left
    monkeypatch.setattr(resample, "noise", lambda id_text, seed: F.lit(0).cast("long"))
    docs = [(k % 30, "same words here") for k in range(100)]
    got = found_draw(spark, docs, ["same"], min_words=3, percent=37)
    drawn = sorted((r[4], r[0]) for r in got if r[4] is not None)
    assert [k for k, _ in drawn] == list(range(1, 38))
    assert [i for _, i in drawn] == sorted(i for i, _ in docs)[:37]
    assert [r[4] for r in found_draw(spark, docs[:9], ["same"], min_words=3)] == [None] * 9
    assert found_draw(spark, [], ["same"]) == []


def test_kth_largest(spark):
    values = [5, 5, 5, -7, 0, 2 ** 62, -2 ** 62, 3, 3, 9]
    df = spark.createDataFrame([(v,) for v in values], "x long")
    order = sorted(values, reverse=True)
    for k in range(1, len(values) + 1):
        value, above = resample.kth_largest(df, F.col("x"), k)
        assert value == order[k - 1] and above == sum(v > value for v in values)


def test_crc_of_long_words_and_runs():
    texts = ["ab " + "c" * 1000 + " Ä9", "", None, "q"]
    got = [b.tolist() for b, _ in resample.features(pa.array(texts), 3)]
    want = [[zlib.crc32(f.encode()) % 10_000 for t in texts for f in
             (lambda w: [" ".join(w[i:i + n]) for i in range(len(w) - n + 1)])(words_of(t))]
            for n in (1, 2, 3)]
    assert got == want


def test_one_per_group_keeps_columns_named_like_helpers(spark):
    text = " ".join(f"w{k}" for k in range(40))
    rows = [(1, text, 5, "a"), (2, text, 6, "b"), (2, text, 6, "b"), (3, text + " x", 7, "c"),
            (4, "other words", 8, "d"), (4, "other words", 8, "d"), (None, None, 9, "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _id int, Kept_ID string")
    kept = near_dup.one_per_group(df)
    assert kept.columns == df.columns
    assert sorted(map(tuple, kept.collect()), key=str) == sorted(
        [rows[0], rows[4], rows[6]], key=str)


def test_shards_stay_even_when_an_id_or_a_row_repeats(spark):
    rng = np.random.default_rng(12)
    texts = ["t" * int(n) for n in rng.integers(20, 60, 3000)]
    rows = [(7 if k % 3 == 0 else (None if k % 50 == 1 else k), f"{t}{k}") for k, t in enumerate(texts)]
    rows += [(9, "the same row again")] * 5000
    df = spark.createDataFrame(rows, "doc_id long, text string")
    placed = sharding.shard(df, 8).collect()
    assert len(placed) == len(rows)
    load, slots = Counter(), {}
    for r in placed:
        load[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert len(load) == 8 and max(load.values()) < 1.02 * min(load.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert Counter(r["doc_id"] for r in placed) == Counter(i for i, _ in rows)


def test_scores_of_large_components(spark):
    big = [float(2 ** 31), 1.0]
    rows = [(0, big), (1, [1.0, 5.0]), (2, [1.0, 4.0]), (3, [-float(2 ** 35), 1.0]), (4, [0.0, 7.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.topk(df, F.col("id") == 0, k=4).collect()
    ints = {i: [math.floor(1024 * x) for x in v] for i, v in rows}
    want = sorted(((-max(-2 ** 63, sum(a * b for a, b in zip(ints[0], v))), i)
                   for i, v in ints.items() if i))
    assert [(-r["score"], r["vec_id"]) for r in sorted(got, key=lambda r: r["rank"])] == want
