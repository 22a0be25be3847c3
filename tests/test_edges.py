"""Planted edge cases no shipped file contains."""

from __future__ import annotations

from pyspark.sql import functions as F

from peerlens.dims import Dimensions
from peerlens.operators import checks
from peerlens.operators.market import enrich_market
from peerlens.operators.twins import find_similar, twins
from peerlens.schemas import BasketSpec, ProfileSpec

DIMS = Dimensions(position_cohort=(("A", "ca"), ("B", "cb"), ("E", "ce")),
                  role_metrics=(("ca", (("m1", 1.0, "M1"), ("m2", 2.0, "M2"))),
                                ("cb", (("m1", 1.0, "M1"),)),
                                ("ce", (("m2", 1.0, "M2"),))),
                  default_cohort="ca")
SPEC = ProfileSpec(key="k", name="k", position="position", league="league", role="role",
                   team="team", age="age", minutes="minutes")


def _df(spark, rows):
    return spark.createDataFrame(
        rows, "k string, position string, league string, role string, team string, age int, "
              "minutes int, m1 double, m2 double")


def _scores(df):
    return {r.k: r.similarity_score for r in df.collect()}


def test_unmapped_position_joins_default_pool(spark):
    rows = [("a1", "A", "L", "r", "t", 20, 1, 0.0, 0.0), ("a2", "A", "L", "r", "t", 20, 1, 2.0, 0.0),
            ("u", "Z", "L", "r", "t", 20, 1, 1.0, 0.0)]
    df = _df(spark, rows)
    got = _scores(find_similar(df, DIMS, SPEC, "u"))
    # pool = {a1, a2} plus u itself: m1 mean 1, pop std sqrt(2/3); d2 = 1.5, m = 2
    import math
    want = round(math.exp(-1.5 / 8) * 100 * 100) / 100
    assert got == {"a1": want, "a2": want}
    # unmapped rows are never candidates of mapped queries
    assert "u" not in _scores(find_similar(df, DIMS, SPEC, "a1"))


def test_null_metric_row_left_out(spark):
    rows = [("a1", "A", "L", "r", "t", 20, 1, 0.0, 1.0), ("a2", "A", "L", "r", "t", 20, 1, 2.0, 3.0),
            ("a3", "A", "L", "r", "t", 20, 1, None, 3.0)]
    df = _df(spark, rows)
    assert set(_scores(find_similar(df, DIMS, SPEC, "a1"))) == {"a2"}
    assert find_similar(df, DIMS, SPEC, "a3").count() == 0
    v = checks.input_violations(df, SPEC, ["m1", "m2"]).first()
    assert v.null_metric_rows == 1


def test_empty_and_single_member_pools(spark):
    rows = [("b1", "B", "L", "r", "t", 20, 1, 1.0, 0.0), ("a1", "A", "L", "r", "t", 20, 1, 1.0, 0.0)]
    df = _df(spark, rows)
    assert find_similar(df, DIMS, SPEC, "b1").count() == 0       # alone in its cohort
    assert find_similar(df, DIMS, SPEC, "b1", strict_position=True).count() == 0


def test_tie_at_k_boundary_breaks_by_key(spark):
    rows = [("q", "A", "L", "r", "t", 20, 1, 0.0, 0.0)] + [
        (f"c{i}", "A", "L", "r", "t", 20, 1, 1.0, 0.0) for i in (3, 1, 2)]
    df = _df(spark, rows)
    r = find_similar(df, DIMS, SPEC, "q", top_n=2).orderBy("rank").collect()
    assert [x.k for x in r] == ["c1", "c2"] and r[0].similarity_score == r[1].similarity_score


def test_k_larger_than_pool(spark):
    rows = [("a1", "A", "L", "r", "t", 20, 1, 0.0, 0.0), ("a2", "A", "L", "r", "t", 20, 1, 1.0, 1.0)]
    assert find_similar(_df(spark, rows), DIMS, SPEC, "a1", top_n=8).count() == 1


def test_duplicates_and_null_position_reported(spark):
    rows = [("a1", "A", "L", "r", "t", 20, 1, 0.0, 0.0), ("a1", "A", "L", "r", "t", 21, 1, 1.0, 0.0),
            ("n", None, "L", "r", "t", 20, 1, 1.0, 0.0)]
    v = checks.input_violations(_df(spark, rows), SPEC, ["m1", "m2"]).first()
    assert (v.duplicate_keys, v.null_positions) == (1, 1)


def test_market_defaults_for_missing_rows(spark):
    players = spark.createDataFrame([("x",), ("y",)], "player_name string")
    market = spark.createDataFrame([("x", 10.0, 20.0, 2, 1.3)],
                                   "player_name string, market_value_eur_m double, "
                                   "wage_gbp_k_pw double, contract_years_left int, "
                                   "resale_potential_multiplier double")
    got = {r.player_name: tuple(r)[1:] for r in
           enrich_market(players, market, "player_name", BasketSpec()).collect()}
    assert got == {"x": (10.0, 20.0, 2, 1.3), "y": (30.0, 60.0, 3, 1.10)}


def test_invariants_fire_on_planted_rows(spark):
    tw = spark.createDataFrame(
        [("q", "q", 101.0, 1, 5, 30, ["L1"], "L2"), ("q", "c", 50.0, 7, 5, None, None, "L1")],
        "ref_key string, k string, similarity_score double, rank int, top_n int, max_age int, "
        "selected_leagues array<string>, league string").withColumn("age", F.lit(31))
    v = checks.twin_violations(tw, SPEC).first()
    assert (v.score_out_of_bounds, v.self_matches, v.over_top_n, v.age_violations,
            v.league_violations) == (1, 1, 1, 1, 1)


def test_batch_queries_with_mixed_parameters(spark):
    rows = [(f"a{i}", "A", "L" + str(i % 2), "r", "t", 18 + i, 1, float(i), float(i * i % 5))
            for i in range(8)]
    df = _df(spark, rows)
    q = spark.createDataFrame([("a0", 20, None, 3), ("a1", None, ["L0"], 2)],
                              "reference string, max_age int, selected_leagues array<string>, "
                              "top_n int")
    out = twins(df, DIMS, SPEC, q).collect()
    a0 = [r for r in out if r.ref_key == "a0"]
    a1 = [r for r in out if r.ref_key == "a1"]
    assert len(a0) == 2 and all(r.age <= 20 for r in a0)      # only a1, a2 are <= 20
    assert len(a1) == 2 and all(r.league == "L0" for r in a1)
