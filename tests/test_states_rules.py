"""Mergeable states, rules with a quarantine, counted sinks, and the checks of
recommendations and baskets on a squad of our own."""

from __future__ import annotations

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from peerlens.dims import FOOTBALL
from peerlens.operators import rules, states
from peerlens.operators.baskets import basket_members, best_baskets
from peerlens.operators.reports import radar_long
from peerlens.operators.twins import find_similar, lookup
from peerlens.schemas import (FOOTBALL_BASKET as BS, FOOTBALL_SPEC as SPEC, MARKET_COLUMNS, SCENARIO,
                              SCOUTING_MASTER)
from peerlens.session import shared_path
from peerlens.sources import write_counted


@pytest.fixture(scope="module")
def squad(spark):
    """60 players of 12 positions with random metrics, and their market."""
    rnd = random.Random(21)
    positions = ["GK", "CB", "LB", "RB", "CDM", "CM", "CAM", "LM", "RM", "LW", "RW", "ST"]
    rows = []
    for i in range(60):
        name = f"Player {chr(65 + i % 26)}{i}"
        rows.append((name, f"T{i % 9}", ["Premier League", "La Liga", "Serie A"][i % 3],
                     positions[i % 12], "Role", rnd.randint(18, 33), rnd.randint(600, 3000),
                     *[rnd.random() * 10 for _ in range(16)],
                     float(rnd.randint(5, 80)), float(rnd.randint(20, 200)), rnd.randint(1, 5),
                     1 + rnd.random()))
    schema = SCOUTING_MASTER
    for f in MARKET_COLUMNS:
        schema = type(schema)([*schema.fields, f])
    return spark.createDataFrame(rows, schema).cache()


def test_similar_players(spark, squad):
    names = [r[0] for r in squad.select("player_name").limit(3).collect()]
    for name in names:
        got = find_similar(squad, FOOTBALL, SPEC, name.upper()).orderBy("rank").collect()
        assert 0 < len(got) <= 5
        assert all(0 <= r.similarity_score <= 100 for r in got)
        assert name not in {r.player_name for r in got}
        scores = [r.similarity_score for r in got]
        assert scores == sorted(scores, reverse=True)
    got = find_similar(squad, FOOTBALL, SPEC, names[1], max_age=25,
                       selected_leagues=["La Liga"], top_n=60).collect()
    assert all(r.age <= 25 and r.league == "La Liga" for r in got)


def test_names_and_unknown_benchmarks(spark, squad):
    name = squad.first()["player_name"]
    assert lookup(squad, SPEC, name.upper()).count() == 1
    assert lookup(squad, SPEC, name, case_insensitive=False).count() == 1
    assert lookup(squad, SPEC, name.upper(), case_insensitive=False).count() == 0
    with pytest.raises(ValueError):
        find_similar(squad, FOOTBALL, SPEC, "nobody", require_match=True)
    pairs = spark.createDataFrame([(name, "nobody")], "cand_key string, bench_key string")
    got = radar_long(pairs, squad, FOOTBALL, SPEC).collect()
    assert got and {r.bench_pct for r in got} == {50.0}
    assert all(0 <= r.cand_pct < 100 for r in got)


def test_baskets_keep_their_limits(spark, squad):
    sc = spark.createDataFrame([("two", 90.0, 250.0, 2, 27.0, 6.0, 6.0, 4.0),
                                ("three", 150.0, 400.0, 3, 28.0, 8.0, 8.0, 6.0)], SCENARIO)
    best = best_baskets(squad, sc, SPEC, BS)
    limits = {r.scenario_id: r for r in sc.collect()}
    per = {}
    for m in basket_members(best, squad, SPEC).collect():
        per.setdefault(m.scenario_id, []).append(m)
    assert set(per) == {"two", "three"}
    for sid, members in per.items():
        s = limits[sid]
        assert len(members) == s.target_signings_count == len({m.position for m in members})
        assert sum(m.market_value_eur_m for m in members) <= s.fee_budget_m
        assert sum(m.wage_gbp_k_pw for m in members) <= s.wage_ceiling_k_pw
        assert statistics.mean(m.age for m in members) <= s.max_avg_age
        assert sum(m.progressive_passes_per90 for m in members) >= s.min_prog_passes


def test_moment_states_merge_and_shrink(spark):
    rnd = random.Random(2)
    rows = [(i, "ab"[i % 2], rnd.gauss(1e6, 3), None if i % 7 == 0 else rnd.random()) for i in range(400)]
    rows += [(1000, "single", 4.0, None)]
    df = spark.createDataFrame(rows, "id int, g string, x double, y double")

    def state(where):
        return states.moment_state(df.where(where), ["g"], ["x", "y"])

    merged = states.merge_moments(["g"], state("id < 100"), state("id BETWEEN 100 AND 130"),
                                  state("id > 130"))
    for got, keep in ((merged, lambda i: True),
                      (states.remove_rows(merged, state("id % 3 = 0"), ["g"]), lambda i: i % 3)):
        found = {(r.g, r.feature): r for r in got.withColumn("sd", states.std_pop()).collect()}
        want = {}
        for i, g, x, y in rows:
            for f, v in (("x", x), ("y", y)):
                if v is not None and keep(i):
                    want.setdefault((g, f), []).append(v)
        assert set(found) == set(want)
        for k, vs in want.items():
            assert found[k].n == len(vs)
            assert math.isclose(found[k]["mean"], statistics.fmean(vs), rel_tol=1e-12)
            assert math.isclose(found[k].sd, statistics.pstdev(vs), rel_tol=1e-6, abs_tol=1e-9)


def test_histogram_states(spark):
    rnd = random.Random(4)
    rows = [(i, "ab"[i % 2], 7.0 if i % 3 == 0 else float(rnd.randint(0, 20))) for i in range(300)]
    df = spark.createDataFrame([*rows, (900, "a", None)], "id int, g string, v double")
    parts = [states.histogram_state(df.where(c), ["g"], "v") for c in ("id < 10", "id >= 10")]
    got = {(r.g, r.value): r for r in
           states.percentiles_of(states.merge_histograms(["g"], *parts), ["g"]).collect()}
    for g in "ab":
        vs = [v for _, k, v in rows if k == g]
        for v in set(vs):
            below, same = sum(x < v for x in vs), vs.count(v)
            r = got.pop((g, v))
            assert r.n == len(vs)
            assert abs(r.strict_pct - below / len(vs) * 100) <= 0.05 + 1e-9
            assert abs(r.average_pct - (below + (same + 1) / 2) / len(vs) * 100) <= 0.05 + 1e-9
    assert not got


def test_rules_set_bad_rows_aside(spark):
    df = spark.createDataFrame([(1, 5.0, "x"), (2, -1.0, None), (3, None, "y"), (4, -2.0, "z")],
                               "id int, fee double, rules_of string")
    listed = [("negative", "fee < 0"), ("no name", "rules_of IS NULL"), ("never", "id > 100")]
    got = rules.apply_rules(df, listed)
    assert (got.rows, got.rejected) == (4, 2)
    assert got.counts == {"negative": 2, "no name": 1, "never": 0}
    assert sorted(r.id for r in got.good.collect()) == [1, 3] and got.good.columns == df.columns
    assert {r.id: list(r.rules) for r in got.bad.collect()} == {2: ["negative", "no name"], 4: ["negative"]}
    table = spark.createDataFrame(listed, "rule string, condition string")
    again = rules.apply_rules(df.where("false"), table)
    assert (again.rows, again.rejected, again.bad.count()) == (0, 0, 0)
    assert rules.apply_rules(df, []).good.count() == 4
    with pytest.raises(ValueError):
        rules.apply_rules(df, [("a", "id = 1"), ("a", "id = 2")])


def test_counts_of_a_written_table(spark):
    path = shared_path(spark, "counted")
    df = spark.range(100).withColumn("p", F.col("id") % 3)
    got = write_counted(df, path, {"large ones": F.col("id") >= 90, "none": F.col("id") < 0},
                        partition_by=["p"])
    assert got == {"rows_written": 100, "large ones": 10, "none": 0}
    assert spark.read.parquet(path).count() == 100


def test_stored_twin_index(spark, squad):
    """The index gives the rows of the search over the profiles."""
    from peerlens.operators.twin_index import build
    index = build(squad, FOOTBALL, SPEC)
    names = [r[0] for r in squad.select("player_name").limit(3).collect()]
    for name, how in ((names[0], {}), (names[1].upper(), {"strict_position": True, "top_n": 2}),
                      (names[2], {"max_age": 27, "selected_leagues": ["Serie A", "La Liga"], "top_n": 9})):
        want = find_similar(squad, FOOTBALL, SPEC, name, **how).orderBy("rank").collect()
        got = index.search(spark, name, **how).orderBy("rank").collect()
        assert [(r.player_name, r.similarity_score, r.rank, r.cohort) for r in got] == [
            (r.player_name, r.similarity_score, r.rank, r.cohort) for r in want]
    one = index.search(spark, names[0])
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "pool" in plan.split("PartitionFilters: [")[1][:60]
    with pytest.raises(ValueError):
        index.search(spark, "nobody")
