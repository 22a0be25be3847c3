"""Large tag sets, repeated requests, prefix sums without exchange reuse."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from peerlens.operators import tags, twins
from peerlens.operators.normalize import percentile_rank
from peerlens.plans.part_profile import PART_SPEC, PARTS, part_profile


def test_compatible_counts_with_large_tag_sets(spark):
    rng = np.random.default_rng(4)
    names = [f"t{k:02d}" for k in range(30)]
    rows = [(k, f"p{k % 2}", sorted(set(rng.choice(names, rng.integers(0, 13)).tolist())))
            for k in range(120)]
    key, pos = PART_SPEC.key, PART_SPEC.position
    df = spark.createDataFrame(rows, f"{key} int, {pos} string, tags array<string>")
    got = {r[key]: r["n_compat"] for r in tags.compat_counts(df, PART_SPEC).collect()}
    want = {k: sum(j != k and q == p and bool(set(t) & set(u)) for j, q, u in rows)
            for k, p, t in rows}
    assert max(len(t) for *_, t in rows) >= 9
    assert got == want


@pytest.mark.parametrize("few", [True, False])
def test_repeated_requests(spark, few):
    profile = part_profile(spark, "/root/testdata/sf0.001")
    name = profile.where(F.col(PART_SPEC.name).isNotNull()).orderBy(PART_SPEC.key).first()[PART_SPEC.name]
    schema = "query_id string, reference string, top_n int"
    one = spark.createDataFrame([("a", name, 3)], schema)
    three = spark.createDataFrame([("a", name, 3), ("b", name.upper(), 3), ("c", name, 2)], schema)

    def answers(q):
        rows = twins.twins(profile, PARTS, PART_SPEC, q, few_queries=few).collect()
        out = {}
        for r in sorted(rows, key=lambda r: r["rank"]):
            out.setdefault(r["query_id"], []).append(r[PART_SPEC.key])
        return out

    alone = answers(one)["a"]
    assert len(alone) == 3 and len(set(alone)) == 3
    assert answers(three) == {"a": alone, "b": alone, "c": alone[:2]}


def test_percentiles_without_exchange_reuse(spark):
    keys = {"spark.sql.exchange.reuse": "false", "spark.sql.adaptive.enabled": "false"}
    old = {k: spark.conf.get(k) for k in keys}
    rng = np.random.default_rng(8)
    values = rng.integers(0, 4000, 20_000).astype(float)
    df = spark.createDataFrame([(k, float(v)) for k, v in enumerate(values)], "k int, m double")
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        got = {r["k"]: r["m_percentile"] for r in percentile_rank(df, ["m"]).collect()}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    order = np.sort(values)
    below, upto = np.searchsorted(order, values, "left"), np.searchsorted(order, values, "right")
    want = (below + upto + 1) / 2 / len(values) * 100
    assert max(abs(got[k] - w) for k, w in enumerate(want)) <= 0.0500001
