"""The nearest-rows step of the twins: cells, boxes and blocks give the exhaustive answer."""

from __future__ import annotations

import math

import numpy as np

from peerlens.operators import near
from peerlens.operators.twins import twins
from peerlens.plans import registry as R

BRANDS = ("Brand#1", "Brand#2", "Brand#24")


def _profile(spark, n=400):
    """Parts of three brands; every tenth repeats its neighbour's figures."""
    rng = np.random.default_rng(5)
    figures = rng.normal(size=(n, 7)).round(2) * 10
    figures[::10] = figures[1::10]
    rows = [(i, f"part {i}", BRANDS[i % 3], "hot" if i % 4 else "red", "gear", "LARGE", i % 50, 900.0,
             int(20 + i % 7), *map(float, f)) for i, f in enumerate(figures)]
    return spark.createDataFrame(
        rows, "p_partkey long, p_label string, p_brand string, p_line string, p_kind string, "
        "p_type string, p_size int, p_retailprice double, n_lines int, qty_avg double, qty_max double, "
        "price_avg_k double, disc_avg double, tax_avg double, ret_share double, open_share double")


def test_cells_equal_the_grid_and_one_cell(spark):
    from pyspark.sql import functions as F
    p = _profile(spark)
    q = p.select(F.col("p_label").alias("reference"),
                 F.when(F.col("p_partkey") % 7 == 0, 20).alias("max_age"),
                 F.when(F.col("p_partkey") % 5 == 0, F.array(F.lit("red"))).alias("selected_leagues"),
                 (F.col("p_partkey") % 3 + 2).cast("int").alias("top_n"))

    def answer(**how):
        return {tuple(r) for r in twins(p, R.DIMS, R.SPEC, q, **how)
                .select("ref_key", "p_partkey", "similarity_score", "rank").collect()}
    pairs = answer(exhaustive_pool=4096)
    assert len(pairs) > 600
    assert answer() == pairs
    assert answer(cell_rows=24) == pairs
    assert answer(cell_rows=24, pair_budget=5000) == pairs


def test_twins_score_no_pair_in_a_join(spark):
    """Pairs are scored in tasks over a cell and a block, not as rows of a join."""
    from pyspark.sql import functions as F
    p = _profile(spark, 60)
    df = twins(p, R.DIMS, R.SPEC, p.select(F.col("p_label").alias("reference"), F.lit(3).alias("top_n")))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "EXP(" not in plan


def test_best_looks_into_few_boxes_and_misses_none():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(3000, 4)), np.ones((500, 4))])
    place = rng.permutation(len(x))
    k = np.tile([1.0, 0.5, 2.0, 0.0], (len(x), 1))
    m = np.full(len(x), 4.0)
    q, c, s = near.best(x, place, x, k, m, np.full(len(x), np.inf), np.full(len(x), 5),
                        lambda a, b: place[b] != place[a])
    got = {}
    for a, b, v in zip(q, c, s):
        got.setdefault(int(a), []).append((-float(v), int(place[b])))
    for a in range(0, len(x), 97):
        d2 = (k[a] * (x - x[a]) ** 2).sum(1)
        score = [round(math.exp(-d / 16) * 10000) / 100 for d in d2]
        want = sorted((-v, int(p)) for i, (v, p) in enumerate(zip(score, place)) if i != a)[:5]
        assert got[a] == want


def test_index_knows_no_such_reference(spark):
    """like ``twins``, a search for a name that no profile has gives no rows."""
    import pytest

    from peerlens.operators.twin_index import build
    index = build(_profile(spark, 60), R.DIMS, R.SPEC)
    with pytest.raises(ValueError):
        index.search(spark, "nobody")
    none = index.search(spark, "nobody", require_match=False)
    some = index.search(spark, "part 3", require_match=False)
    assert none.collect() == [] and len(some.collect()) == 5
    assert len(none.unionByName(some).collect()) == 5


def test_vectors_in_chunks(spark):
    """chunks and blocks give the plain answer; vectors that are not whole
    have no score and rank last; equal vectors lose no row."""
    from peerlens.operators.vectors import vector_twins
    rng = np.random.default_rng(3)
    data = [(i, [float(x) for x in v], i % 2) for i, v in enumerate(rng.normal(size=(120, 6)).round(1))]
    data += [(200 + i, [1.0] * 6, 0) for i in range(20)] + [(300, [1.0] * 5, 1), (301, [None] * 6, 1)]
    df = spark.createDataFrame(data, "id long, v array<double>, label int")

    def answer(**how):
        return sorted(tuple(r) for r in vector_twins(df, "id", "v", "label", top_n=4, **how).collect())
    one = answer()
    assert answer(exhaustive_label=4, chunk_rows=16, pair_budget=2000) == one
    assert len(one) == 4 * len(data)
    got = {(r[0], r[4]): (r[2], r[3]) for r in one}
    assert got[(205, 1)] == (200, 100.0) and got[(200, 4)] == (204, 100.0)
    assert [got[(300, n)] for n in (1, 2)] == [(1, None), (3, None)]
    scale = {c: np.array([v for _, v, k in data[:140] if k == c]).std(0) for c in (0,)}
    a = data[8][1]
    d2 = {i: (((np.array(a) - v) / scale[0]) ** 2).sum() for i, v, k in data if k == 0 and i != 8}
    want = sorted((-round(math.exp(-d / 24) * 10000) / 100, i) for i, d in d2.items())[:4]
    assert [got[(8, n)] for n in (1, 2, 3, 4)] == [(i, -s) for s, i in want]


def test_skyline_drops_copies_before_the_rounds(spark, monkeypatch):
    """rows alike in all but the key never reach the rounds or the grid."""
    from peerlens.operators import baskets as B
    kept = []

    def counted(df):
        kept.append(df.count())
        return df
    monkeypatch.setattr(B, "_materialize", counted)
    columns = ["p_partkey", "p_brand", "fee", "wage", "p_size", "qty_avg", "n_lines", "ret_share", "open_share",
               "resale"]
    rows = [(i, "Brand#1", 1.0 + i % 2, 2.0 - i % 2, 3, 1.0, 30, 0.5, 0.5, 1.1) for i in range(40)]
    rows.append((0, *rows[0][1:]))              # the same row twice: neither dominates the other
    got = sorted(r.key for r in B.skyline(spark.createDataFrame(rows, columns), R.SPEC, R.BSPEC, group=4).collect())
    assert got == [0, 0, 1] and max(kept) == 3


def test_boxes_answer_like_runs():
    """going from box to box misses no row, whatever factors, filters and limits."""
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(size=(1500, 6)), rng.normal(size=(20, 6)).repeat(40, 0)])
    n, age = len(x), rng.integers(0, 40, len(x))
    qx = np.concatenate([x[::3], 30 + rng.normal(size=(5, 6))])
    place, own = rng.permutation(n), rng.integers(0, n, len(qx))
    for k in (np.ones((len(qx), 6)), rng.uniform(0, 3, (len(qx), 6)), np.full((len(qx), 6), 1e-9)):
        m, top = np.full(len(qx), 6.0), rng.integers(1, 6, len(qx))
        oldest = np.where(np.arange(len(qx)) % 4 == 0, 2, 50)

        def allowed(q, c):
            return (place[c] != own[q]) & (age[c] <= oldest[q])
        for limit in (np.full(len(qx), np.inf), rng.uniform(0.5, 2, len(qx))):
            some = [near._by_box(x, place, qx, k, m, limit, top, allowed),
                    near._by_run(x, place, qx, k, m, np.full(len(qx), np.inf), top, allowed, True)]
            got, want = [{(int(q), int(c)): float(s) for q, c, s in zip(*one)} for one in some]
            if np.isfinite(limit).all():    # the rows within the limit are known to be enough
                d2 = (k[:, None, :] * (x[None] - qx[:, None]) ** 2).sum(2)
                want = {p: s for p, s in want.items() if d2[p] <= limit[p[0]]}
                got = {p: s for p, s in got.items() if d2[p] <= limit[p[0]]}
            assert got == want


def test_first_split_leaves_little_to_the_rounds(spark, monkeypatch):
    """a pool is cut to cells at once, not by a round over all rows per halving."""
    from pyspark.sql import functions as F

    from peerlens.operators import cells
    rng = np.random.default_rng(2)
    rows = [(i, "a" if i % 8 else "b", float(v[0]), float(v[1])) for i, v in enumerate(rng.normal(size=(6000, 2)))]
    df = spark.createDataFrame(rows, "id long, g string, x double, y double")
    written, stored = [], cells.stored
    monkeypatch.setattr(cells, "stored", lambda d, name: written.append(name) or stored(d, name))
    cut = df.withColumn("cell", cells.first_split(df, "g", ["x", "y"], "id", 800))
    out = cells.equi_depth(cut, ["g"], ["x", "y"], "id", 800)
    held = {(r.g, r.cell): r["count"] for r in out.groupBy("g", "cell").count().collect()}
    assert max(held.values()) <= 800 and sum(held.values()) == 6000 and held[("b", "")] == 750
    assert written.count("cells") <= 1 and out.select(F.count_distinct("id")).first()[0] == 6000


def test_display_columns_cost_no_join_where_none_are_wanted(spark):
    """Ranks and scores alone need no look-up of the candidates."""
    from pyspark.sql import functions as F
    p = _profile(spark, 60)
    q = p.select(F.col("p_label").alias("reference"), F.lit(3).alias("top_n"))
    plain, full = (twins(p, R.DIMS, R.SPEC, q, display=d) for d in (False, True))
    both = ["ref_key", "p_partkey", "similarity_score", "rank"]
    assert sorted(plain.select(both).collect()) == sorted(full.select(both).collect())
    assert "x1" in full.columns and "x1" not in plain.columns
    joins = [d.select(both)._jdf.queryExecution().optimizedPlan().toString().count("Join") for d in (plain, full)]
    assert joins[0] < joins[1]


def test_grid_of_the_skyline_compares_in_tasks(spark):
    """a task compares thousands of rows, so rows are copied by the ten thousands
    of a position and not by the hundreds; dominance is that of the SQL."""
    import pyarrow as pa

    from peerlens.operators import baskets as B
    rng = np.random.default_rng(4)
    columns = ("fee", "wage", "age", "prog", "dfn", "cre", "value")

    def table(n):
        x = rng.integers(0, 4, (n, 7)).astype(float)
        x[rng.random((n, 7)) < 0.02] = np.nan                   # the largest number in Spark
        return pa.table({"pos": ["p"] * n, "key": rng.integers(0, 2 * n, n),
                         **{c: x[:, j] for j, c in enumerate(columns)}})

    def number(v):
        return (math.isnan(v), 0.0 if math.isnan(v) else v)

    rows, others = table(300), table(700)
    a, o = ([[*map(number, (r[c] for c in columns)), r["key"]] for r in t.to_pylist()] for t in (rows, others))
    want = [i for i, r in enumerate(a) if any(
        s[7] != r[7] and all(s[j] <= r[j] for j in range(3)) and all(s[j] >= r[j] for j in range(3, 6))
        and (s[6] > r[6] or (s[6] == r[6] and s[7] < r[7])) for s in o)]
    assert 0 < len(want) < 300 and B._dominated(rows, others).tolist() == want

    items = spark.createDataFrame(
        [("p", i, float(i), float(-i), 1.0, 1.0, 1.0, 1.0, 1.0) for i in range(400)],
        "pos string, key long, fee double, wage double, age double, prog double, dfn double, cre double, value double")
    out = B._salted_skyline(items, 8)
    assert out.count() == 400
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "LeftSemi" not in plan
