"""Best-value baskets of exactly k entities under budget constraints.

Exact optimum for every row of a scenarios table, without a solver: the market
is stored once as trees of boxes (``descent.basket_index``) and one descent
through them answers all scenarios, of any sizes, at once.  Best basket per
scenario: value (to nine digits) desc, then the sorted key list asc; scenarios
with none get status ``infeasible``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peerlens.operators.descent import (TOL, BasketIndex, basket_index,  # noqa: F401 (TOL: checks)
                                        best_labels, descend)
from peerlens.operators.market import composite_value_expr
from peerlens.operators.near import _boxes
from peerlens.schemas import BasketSpec, ProfileSpec
from peerlens.session import materialize as _materialize
from peerlens.session import released


def basket_items(market: DataFrame, spec: ProfileSpec, bspec: BasketSpec) -> DataFrame:
    """Normalised item rows; rows with a null input are left out (C17 counts them)."""
    items = market.select(
        F.col(spec.key).alias("key"), F.col(spec.position).alias("pos"),
        F.col(bspec.fee).cast("double").alias("fee"),
        F.col(bspec.wage).cast("double").alias("wage"),
        F.col(spec.age).cast("double").alias("age"),
        F.col(bspec.prog).cast("double").alias("prog"),
        F.col(bspec.defence).cast("double").alias("dfn"),
        (F.col(bspec.creation_a) + F.col(bspec.creation_b)).cast("double").alias("cre"),
        composite_value_expr(bspec).alias("value"))
    ok = F.lit(True)
    for c in ("key", "pos", "fee", "wage", "age", "prog", "dfn", "cre", "value"):
        ok = ok & F.col(c).isNotNull()
    return items.where(ok)


def market_index(market: DataFrame, spec: ProfileSpec, bspec: BasketSpec,
                 prune: bool = True) -> BasketIndex:
    """The stored search trees of a market, for any number of ``best_baskets``."""
    return basket_index(basket_items(market, spec, bspec), prune)


def best_baskets(market: DataFrame, scenarios: DataFrame, spec: ProfileSpec, bspec: BasketSpec,
                 prune: bool = True, index: BasketIndex | None = None) -> DataFrame:
    """One row per scenario: status, sorted member keys, totals.

    ``prune``: whether dominated items are left out of the trees; ``index``:
    trees stored before, to answer a further table of scenarios."""
    out = scenarios.select(F.col("scenario_id").cast("string").alias("scenario_id"),
                           F.col("target_signings_count").cast("int").alias("k"))
    least, most = out.agg(F.min("k"), F.max("k")).first()
    if least is not None and least < 1:
        raise ValueError(f"a scenario asks for a basket of size {least}, below 1")
    index = index or market_index(market, spec, bspec, prune)
    members = most or 1
    best = best_labels(index, descend(index, scenarios, members), members)
    res = (out.join(best.withColumnRenamed("sid", "scenario_id"), "scenario_id", "left")
              .select("scenario_id",
                      F.when(F.col("keys").isNull(), F.lit("infeasible"))
                       .otherwise(F.lit("optimal")).alias("status"),
                      "k", "keys", "total_value", "total_fee", "total_wage"))
    # one row per scenario: stored once for members, KPIs and checks
    return _materialize(res)


def basket_members(best: DataFrame, market: DataFrame, spec: ProfileSpec) -> DataFrame:
    """One row per (scenario, member) with the member's market row (P2 source)."""
    m = best.where(F.col("status") == "optimal").select(
        "scenario_id", F.posexplode("keys").alias("slot", "_key"))
    return m.join(market, m["_key"] == market[spec.key]).drop("_key")


def basket_kpis(best: DataFrame, market: DataFrame, scenarios: DataFrame,
                spec: ProfileSpec, bspec: BasketSpec) -> DataFrame:
    """Spent, saved, surplus over floors, age under cap per scenario."""
    mem = basket_members(best, market, spec)
    agg = mem.groupBy("scenario_id").agg(
        F.sum(F.col(bspec.fee).cast("double")).alias("spent_fee"),
        F.sum(F.col(bspec.wage).cast("double")).alias("spent_wages"),
        F.sum(F.col(bspec.prog).cast("double")).alias("combined_prog"),
        F.sum(F.col(bspec.defence).cast("double")).alias("combined_def"),
        F.avg(F.col(spec.age).cast("double")).alias("portfolio_age"),
        F.count(F.lit(1)).alias("n_players"))
    sc = scenarios.select(F.col("scenario_id").cast("string").alias("scenario_id"),
                          *[F.col(c).cast("double").alias(c) for c in
                            ("fee_budget_m", "wage_ceiling_k_pw", "max_avg_age",
                             "min_prog_passes", "min_defensive_actions")])
    j = sc.join(agg, "scenario_id")
    return j.select(
        "scenario_id", "n_players", "spent_fee", "spent_wages", "combined_prog",
        "combined_def", "portfolio_age",
        (F.col("fee_budget_m") - F.col("spent_fee")).alias("fee_saved"),
        (F.col("wage_ceiling_k_pw") - F.col("spent_wages")).alias("wage_saved"),
        (F.col("combined_prog") - F.col("min_prog_passes")).alias("prog_surplus"),
        (F.col("combined_def") - F.col("min_defensive_actions")).alias("def_surplus"),
        (F.col("max_avg_age") - F.col("portfolio_age")).alias("age_under_cap"))


SKY_GROUP = 512          # items per local-skyline group
SKY_SHRINK = 0.9         # a round keeping more than this share ends the rounds
CHUNKS = 32              # groups that a task of the grid compares at once


def _dominates(i: DataFrame, o: DataFrame) -> Column:
    """o dominates i: no worse on every attribute, better (value, key)."""
    return ((o["o_fee"] <= i["fee"]) & (o["o_wage"] <= i["wage"]) & (o["o_age"] <= i["age"])
            & (o["o_prog"] >= i["prog"]) & (o["o_dfn"] >= i["dfn"]) & (o["o_cre"] >= i["cre"])
            & ((o["o_value"] > i["value"])
               | ((o["o_value"] == i["value"]) & (o["o_key"] < i["key"]))))


def _local_skyline(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows not dominated by another row with the same ``keys``."""
    o = df.select(*[F.col(c).alias(f"o_{c}") for c in df.columns])
    cond = None
    for k in keys:
        e = df[k] == o[f"o_{k}"]
        cond = e if cond is None else cond & e
    return df.join(o, cond & (o["o_key"] != df["key"]) & _dominates(df, o), "left_anti")


def skyline(market: DataFrame, spec: ProfileSpec, bspec: BasketSpec,
            group: int = SKY_GROUP, max_rounds: int = 32) -> DataFrame:
    """Items not dominated by another item of the same position.

    i dominates j when fee, wage, age are <= and prog, def, creation >=,
    with a strictly higher value (or equal value and smaller key) -- a
    strict partial order, so a row dominated inside any subset is dominated
    globally and the skyline of a position is the skyline of the union of
    its groups' local skylines.  Rounds: hash the surviving items of each
    position into groups of at most ``group`` rows (a fresh seed per round)
    and keep each group's local skyline; a position that fits one group is
    final.  No task compares more than ``group``^2 pairs, a hot position
    included.  If a round stops shrinking (anti-correlated data, the
    skyline is most of the rows) the rest is settled by a grid of salts,
    also bounded per task."""
    items = basket_items(market, spec, bspec)
    # of rows alike in all but the key, the smallest key dominates the others:
    # they leave before any round, where they seldom share a group
    alike = Window.partitionBy(*[c for c in items.columns if c != "key"])
    with released(market.sparkSession):
        cur = _materialize(items.withColumn("_first", F.min("key").over(alike))
                           .where(F.col("key") == F.col("_first")).drop("_first"))
    prev = None
    for r in range(max_rounds):
        cnt = cur.groupBy("pos").agg(F.count(F.lit(1)).alias("_n"))
        st = cnt.agg(F.max("_n").alias("mx"), F.sum("_n").alias("tot")).first()
        if st["mx"] is None or st["mx"] <= group:
            return _local_skyline(cur, ["pos"])
        if prev is not None and st["tot"] > SKY_SHRINK * prev:
            break
        prev = st["tot"]
        salted = (cur.join(cnt, "pos")
                  .withColumn("_g", F.pmod(F.xxhash64("key", F.lit(r)),
                                           F.ceil(F.col("_n") / F.lit(float(group))))
                              .cast("int"))
                  .drop("_n"))
        with released(market.sparkSession):
            cur = _materialize(_local_skyline(salted, ["pos", "_g"]).drop("_g"))
    return _salted_skyline(cur, group)


def _salted_skyline(items: DataFrame, group: int) -> DataFrame:
    """Exact skyline by a grid of (position, i-salt, o-salt) tasks: each
    task finds the rows of its i-salt dominated by its o-salt; a row is in
    the skyline when no task marks it.

    A salt has ``CHUNKS`` times ``group`` rows, which a task compares by array
    operations (``_dominated``): a row is copied once per salt of its position,
    and only marked keys leave a task."""
    nparts = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ns = (items.groupBy("pos").agg(F.ceil(F.count(F.lit(1)) / F.lit(float(group * CHUNKS)))
                                   .cast("int").alias("_ns")))
    salt = F.pmod(F.xxhash64("key"), F.col("_ns")).cast("int")
    i = (items.join(ns, "pos").withColumn("_si", salt)
         .withColumn("_so", F.explode(F.sequence(F.lit(0), F.col("_ns") - 1))).drop("_ns")
         .repartition(nparts, "pos", "_si", "_so"))
    o = (items.join(ns, "pos").withColumn("_so", salt)
         .withColumn("_si", F.explode(F.sequence(F.lit(0), F.col("_ns") - 1))).drop("_ns"))
    o = o.select(*[F.col(c).alias(f"o_{c}") for c in o.columns]).repartition(
        nparts, "o_pos", "o__si", "o__so")
    schema = items.select("pos", "key").schema

    def mark(rows: pa.Table, others: pa.Table) -> pa.Table:
        others = others.rename_columns([c[2:] for c in others.column_names])
        hit = _dominated(rows, others) if rows.num_rows and others.num_rows else []
        return rows.select(["pos", "key"]).take(pa.array(hit, pa.int64()))

    dominated = (i.groupBy("pos", "_si", "_so").cogroup(o.groupBy("o_pos", "o__si", "o__so"))
                 .applyInArrow(mark, schema).distinct())
    return items.join(dominated, ["pos", "key"], "left_anti")


def _dominated(rows: pa.Table, others: pa.Table) -> np.ndarray:
    """Rows that one of ``others`` dominates (``_dominates``; equal keys do not count).

    All compared as ranks, numbers in Spark's order; boxes of ``others`` that can
    dominate a row are looked into, for rows that none has dominated yet."""
    def ranks(column: str) -> np.ndarray:
        both = np.concatenate([t.column(column).to_pandas().to_numpy() for t in (rows, others)])
        return np.unique(both, return_inverse=True)[1].astype(np.int32)

    n = rows.num_rows
    key, value = ranks("key"), ranks("value")
    place = np.empty(len(key), np.int32)        # value downwards, then key
    place[np.lexsort((key, -value))] = np.arange(len(key))
    at = np.stack([ranks("fee"), ranks("wage"), ranks("age"), -ranks("prog"), -ranks("dfn"),
                   -ranks("cre"), place], 1)
    a, o, own, keys = at[:n], at[n:], key[:n], key[n:]
    boxes = _boxes(o)
    low = np.array([o[b].min(0) for b in boxes])
    out = np.zeros(n, bool)
    for b in np.argsort(low.astype(float).sum(1), kind="stable"):       # the strongest first
        left = np.flatnonzero(~out)
        left = left[(low[b] <= a[left]).all(1)]
        members = boxes[b]
        for s in range(0, len(left), 4096):
            q = left[s:s + 4096]
            worse = o[members, 6] < a[q, 6][:, None]
            for j in range(6):
                worse &= o[members, j] <= a[q, j][:, None]
            worse &= keys[members] != own[q][:, None]
            out[q[worse.any(1)]] = True
    return np.flatnonzero(out)
