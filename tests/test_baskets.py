"""Basket optimiser: goldens, infeasible status, exactness vs brute force."""

from __future__ import annotations

import itertools
import random

from pyspark.sql import functions as F

from peerlens.operators.baskets import basket_kpis, best_baskets, skyline
from peerlens.operators.market import composite_value_expr
from peerlens.schemas import FOOTBALL_BASKET as BS, FOOTBALL_SPEC as SPEC, SCENARIO

GOLD = ["Adam Wharton", "Pedro Porro"]


def _scen(spark, rows):
    return spark.createDataFrame(rows, SCENARIO)


def test_goldens(spark, market):
    sc = _scen(spark, [
        ("ui", 90.0, 170.0, 2, 23.5, 11.0, 7.0, 0.40),
        ("defaults", 95.0, 180.0, 2, 24.0, 10.0, 5.0, 0.60),
        ("t_budget", 90.0, 170.0, 2, 24.0, 8.0, 5.0, 0.60),
        ("t_diverse", 100.0, 200.0, 2, 24.0, 10.0, 5.0, 0.60),
        ("ui_k3", 90.0, 170.0, 3, 23.5, 11.0, 7.0, 0.40),
        ("poor", 30.0, 50.0, 2, 20.0, 16.0, 14.0, 1.5)])
    got = {r.scenario_id: r for r in best_baskets(market, sc, SPEC, BS).collect()}
    for sid in ("ui", "defaults", "t_budget", "t_diverse"):
        assert got[sid].status == "optimal" and got[sid].keys == GOLD
        assert abs(got[sid].total_value - 8.815) < 1e-9
        assert (got[sid].total_fee, got[sid].total_wage) == (87.0, 145.0)
    assert got["ui_k3"].status == "infeasible" and got["ui_k3"].keys is None
    assert got["poor"].status == "infeasible"
    k = basket_kpis(best_baskets(market, sc.where("scenario_id = 'ui'"), SPEC, BS), market,
                    sc, SPEC, BS).first()
    assert (k.spent_fee, k.fee_saved, k.wage_saved, k.portfolio_age) == (87.0, 3.0, 25.0, 22.0)


def test_skyline_keeps_48(market):
    assert skyline(market, SPEC, BS).count() == 48


def test_skyline_rounds_and_grid_equal_one_pass(spark):
    """Salted local-skyline rounds and the grid fallback give the exact
    skyline (checked against a brute-force dominance scan in Python)."""
    from conftest import SMALL_SF
    from peerlens.operators.baskets import basket_items
    from peerlens.plans import registry as R
    mk = R.market_table(spark, SMALL_SF).cache()
    rows = basket_items(mk, R.SPEC, R.BSPEC).collect()

    def dom(o, i):
        return (o.pos == i.pos and o.key != i.key and o.fee <= i.fee and o.wage <= i.wage
                and o.age <= i.age and o.prog >= i.prog and o.dfn >= i.dfn and o.cre >= i.cre
                and (o.value > i.value or (o.value == i.value and o.key < i.key)))
    brute = {i.key for i in rows if not any(dom(o, i) for o in rows)}
    for group in (512, 4, 2):
        got = {r.key for r in skyline(mk, R.SPEC, R.BSPEC, group=group).collect()}
        assert got == brute, group


def _brute(items, s):
    sid, fee_b, wage_b, k, cap, fp, fd, fc = s
    best = None
    for combo in itertools.combinations(items, k):
        if len({c["pos"] for c in combo}) < k:
            continue
        tol = 1e-6
        if (sum(c["fee"] for c in combo) <= fee_b + tol and sum(c["wage"] for c in combo) <= wage_b + tol
                and sum(c["age"] - cap for c in combo) <= tol
                and sum(c["prog"] for c in combo) >= fp - tol
                and sum(c["dfn"] for c in combo) >= fd - tol
                and sum(c["cre"] for c in combo) >= fc - tol):
            v = round(sum(c["value"] for c in combo), 9)
            keys = sorted(c["key"] for c in combo)
            cand = (-v, keys)
            if best is None or cand < best:
                best = cand
    return None if best is None else best[1]


def test_exact_against_brute_force(spark, monkeypatch):
    rnd = random.Random(7)
    rows = []
    for i in range(36):
        # coarse values: many ties in every criterion and in value
        rows.append((f"p{i:02d}", f"P{rnd.randint(0, 5)}", "T", "L", "R", rnd.randint(18, 30),
                     float(rnd.randint(1, 6) * 10), float(rnd.randint(1, 6) * 20),
                     float(rnd.randint(2, 8)), float(rnd.randint(1, 5)),
                     float(rnd.choice([0.1, 0.2, 0.3])), float(rnd.choice([0.1, 0.2])),
                     float(rnd.choice([1.0, 1.2]))))
    df = spark.createDataFrame(rows, "player_name string, position string, team string, "
                               "league string, primary_role string, age int, "
                               "market_value_eur_m double, wage_gbp_k_pw double, "
                               "progressive_passes_per90 double, tackles_interceptions_per90 double, "
                               "xag_per90 double, npxg_per90 double, resale_potential_multiplier double")
    scen = []
    for i in range(14):
        k = 2 if i % 2 == 0 else 3
        scen.append((f"s{i}", float(rnd.randint(4, 14) * 10), float(rnd.randint(4, 14) * 20), k,
                     float(rnd.randint(20, 28)), float(rnd.randint(4, 14)), float(rnd.randint(2, 9)),
                     float(rnd.choice([0.3, 0.6, 0.9]))))
    items = [r.asDict() for r in df.select(
        F.col("player_name").alias("key"), F.col("position").alias("pos"),
        F.col("market_value_eur_m").alias("fee"), F.col("wage_gbp_k_pw").alias("wage"),
        F.col("age").cast("double").alias("age"), F.col("progressive_passes_per90").alias("prog"),
        F.col("tackles_interceptions_per90").alias("dfn"),
        (F.col("xag_per90") + F.col("npxg_per90")).alias("cre"),
        composite_value_expr(BS).alias("value")).collect()]
    want = {s[0]: _brute(items, s) for s in scen}
    sc = _scen(spark, scen)
    import peerlens.operators.descent as D
    for prune, cell in ((True, D.CELL), (False, D.CELL), (True, 3), (False, 2)):
        monkeypatch.setattr(D, "CELL", cell)     # small cells: several trees per position
        got = {r.scenario_id: r.keys for r in best_baskets(df, sc, SPEC, BS, prune=prune).collect()}
        assert got == want, (prune, cell)
    assert any(v is None for v in want.values()) and any(v is not None for v in want.values())


def test_any_size_against_brute_force(spark):
    """Baskets of 1 and 4 in one table, and the stored trees asked again."""
    import peerlens.operators.baskets as B
    rnd = random.Random(11)
    rows = [(f"p{i:02d}", f"P{i % 6}", "T", "L", "R", rnd.randint(18, 30), float(rnd.randint(1, 6) * 10),
             float(rnd.randint(1, 6) * 20), float(rnd.randint(2, 8)), float(rnd.randint(1, 5)), 0.1,
             float(rnd.choice([0.1, 0.2])), float(rnd.choice([1.0, 1.2]))) for i in range(18)]
    df = spark.createDataFrame(rows, "player_name string, position string, team string, "
                               "league string, primary_role string, age int, "
                               "market_value_eur_m double, wage_gbp_k_pw double, "
                               "progressive_passes_per90 double, tackles_interceptions_per90 double, "
                               "xag_per90 double, npxg_per90 double, resale_potential_multiplier double")
    scen = [(f"s{i}", k * float(rnd.randint(2, 5) * 10), k * float(rnd.randint(3, 6) * 20), k,
             float(rnd.randint(22, 28)), k * float(rnd.randint(2, 5)), k * float(rnd.randint(1, 3)), 0.2 * k)
            for i, k in enumerate([1, 1, 1, 4, 4, 4])]
    items = [r.asDict() for r in B.basket_items(df, SPEC, BS).collect()]
    want = {s[0]: _brute(items, s) for s in scen}
    assert any(want.values()) and len({s[3] for s in scen if want[s[0]]}) > 1
    index = B.market_index(df, SPEC, BS)
    for part, prune in ((scen, True), (scen, False), (scen[:2], True)):
        got = {r.scenario_id: r.keys
               for r in best_baskets(df, _scen(spark, part), SPEC, BS, prune=prune,
                                     index=index if prune else None).collect()}
        assert got == {sid: want[sid] for sid, *_ in part}, prune
    assert best_baskets(df, _scen(spark, []), SPEC, BS, index=index).collect() == []
    none = best_baskets(df.where("false"), _scen(spark, scen), SPEC, BS).collect()
    assert {r.status for r in none} == {"infeasible"} and len(none) == len(scen)


def _spec_items(spark, rows):
    return spark.createDataFrame(rows, "player_name string, position string, team string, "
                                 "league string, primary_role string, age int, "
                                 "market_value_eur_m double, wage_gbp_k_pw double, "
                                 "progressive_passes_per90 double, tackles_interceptions_per90 double, "
                                 "xag_per90 double, npxg_per90 double, resale_potential_multiplier double")


def test_many_scenarios_in_one_descent(spark):
    """1,000 scenarios at once give what brute force gives for each."""
    rnd = random.Random(5)
    rows = [(f"p{i:02d}", f"P{i % 4}", "T", "L", "R", rnd.randint(18, 30), float(rnd.randint(10, 60)),
             float(rnd.randint(20, 120)), rnd.random() * 8, rnd.random() * 5, rnd.random() / 2,
             rnd.random() / 2, 1 + rnd.random()) for i in range(24)]
    df = _spec_items(spark, rows)
    scen = [(f"s{i}", float(rnd.randint(30, 120)), float(rnd.randint(60, 240)), rnd.randint(1, 2),
             float(rnd.randint(20, 28)), rnd.random() * 8, rnd.random() * 5, rnd.random())
            for i in range(1000)]
    items = [r.asDict() for r in __import__("peerlens.operators.baskets", fromlist=["x"])
             .basket_items(df, SPEC, BS).collect()]
    want = {s[0]: _brute(items, s) for s in scen}
    got = {r.scenario_id: r.keys for r in best_baskets(df, _scen(spark, scen), SPEC, BS).collect()}
    assert got == want
    assert 100 < sum(v is None for v in want.values()) < 900


def test_infeasible_baskets_of_feasible_items(spark):
    """Every item is within the bounds with some partner, no pair is within all."""
    rows = [(f"a{i}", "A", "T", "L", "R", 20, 10.0 + i, 90.0 - i, 5.0, 3.0, 0.2, 0.2, 1.0) for i in range(40)]
    rows += [(f"b{i}", "B", "T", "L", "R", 20, 10.0 + i, 90.0 - i, 5.0, 3.0, 0.2, 0.2, 1.0) for i in range(40)]
    sc = _scen(spark, [("no", 60.0, 139.0, 2, 30.0, 1.0, 1.0, 0.1), ("yes", 60.0, 140.0, 2, 30.0, 1.0, 1.0, 0.1)])
    got = {r.scenario_id: r.status for r in best_baskets(_spec_items(spark, rows), sc, SPEC, BS).collect()}
    assert got == {"no": "infeasible", "yes": "optimal"}


def test_dominated_items_leave_the_trees(spark):
    """Of 5,000 correlated items few are left to search."""
    import peerlens.operators.baskets as B
    rnd = random.Random(9)
    rows = []
    for i in range(5000):
        q = rnd.random()                  # good ones are cheap, young and strong
        rows.append((f"p{i:04d}", f"P{i % 5}", "T", "L", "R", 18 + int(20 * (1 - q)), 60 - 50 * q,
                     120 - 100 * q, 8 * q, 5 * q, q / 2, q / 2, 1 + q))
    index = B.market_index(_spec_items(spark, rows), SPEC, BS)
    assert index.edges.where("leaf AND parent = id").count() < 500


def test_equi_depth_cells(spark):
    from peerlens.operators.cells import equi_depth
    rnd = random.Random(3)
    rows = [(i, "hot" if i % 3 else "g%d" % (i % 7), rnd.random(), float(rnd.randint(0, 3)), 1.0)
            for i in range(2000)]
    rows += [(i, "same", 1.0, 2.0, 3.0) for i in range(2000, 2300)]      # equal points
    df = spark.createDataFrame(rows, "id long, g string, x double, y double, z double")
    out = equi_depth(df, ["g"], ["x", "y", "z"], "id", 50).collect()
    assert sorted(r.id for r in out) == list(range(2300))
    held = {}
    for r in out:
        held.setdefault((r.g, r.cell), []).append(r)
    assert max(map(len, held.values())) <= 50
    hot = [v for (g, _), v in held.items() if g == "hot"]
    assert len(hot) <= 1334 // 50 * 3 and min(map(len, hot)) >= 5
