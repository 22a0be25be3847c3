"""Result invariants as data checks (C17, A10): one row of violation counts.

Each rule is a ``count_if`` over an operator output, so the whole check
is a handful of partial aggregates, never a collect of the results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peerlens.operators.baskets import TOL
from peerlens.schemas import BasketSpec, ProfileSpec


def twin_violations(tw: DataFrame, spec: ProfileSpec) -> DataFrame:
    return tw.agg(
        F.count_if((F.col("similarity_score") < 0) | (F.col("similarity_score") > 100))
         .alias("score_out_of_bounds"),
        F.count_if(F.col("ref_key") == F.col(spec.key)).alias("self_matches"),
        F.count_if(F.col("rank") > F.col("top_n")).alias("over_top_n"),
        F.count_if(F.col("max_age").isNotNull() & (F.col(spec.age) > F.col("max_age")))
         .alias("age_violations"),
        F.count_if(F.col("selected_leagues").isNotNull() & (F.size("selected_leagues") > 0)
                   & ~F.array_contains(F.col("selected_leagues"), F.col(spec.league)))
         .alias("league_violations"))


def basket_violations(best: DataFrame, members: DataFrame, scenarios: DataFrame,
                      spec: ProfileSpec, bspec: BasketSpec) -> DataFrame:
    per = members.groupBy("scenario_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct(spec.position).alias("npos"),
        F.sum(bspec.fee).alias("fee"), F.sum(bspec.wage).alias("wage"),
        F.avg(F.col(spec.age).cast("double")).alias("age"),
        F.sum(bspec.prog).alias("prog"), F.sum(bspec.defence).alias("dfn"),
        F.sum(F.col(bspec.creation_a) + F.col(bspec.creation_b)).alias("cre"))
    sc = scenarios.select(F.col("scenario_id").cast("string").alias("scenario_id"),
                          F.col("fee_budget_m").alias("b"), F.col("wage_ceiling_k_pw").alias("w"),
                          F.col("target_signings_count").alias("k"),
                          F.col("max_avg_age").alias("cap"), F.col("min_prog_passes").alias("f_prog"),
                          F.col("min_defensive_actions").alias("f_dfn"),
                          F.col("min_creation_threat").alias("f_cre"))
    j = per.join(sc, "scenario_id")
    return j.agg(
        F.count_if(F.col("fee") > F.col("b") + F.lit(TOL)).alias("over_fee_budget"),
        F.count_if(F.col("wage") > F.col("w") + F.lit(TOL)).alias("over_wage_ceiling"),
        F.count_if(F.col("age") > F.col("cap") + F.lit(TOL)).alias("over_age_cap"),
        F.count_if(F.col("prog") < F.col("f_prog") - F.lit(TOL)).alias("under_prog_floor"),
        F.count_if(F.col("dfn") < F.col("f_dfn") - F.lit(TOL)).alias("under_defence_floor"),
        F.count_if(F.col("cre") < F.col("f_cre") - F.lit(TOL)).alias("under_creation_floor"),
        F.count_if(F.col("n") != F.col("k")).alias("wrong_basket_size"),
        F.count_if(F.col("npos") != F.col("n")).alias("duplicate_positions"))


def input_violations(profile: DataFrame, spec: ProfileSpec, metrics: list[str]) -> DataFrame:
    null_metric = F.lit(False)
    for m in metrics:
        null_metric = null_metric | F.col(m).isNull()
    return profile.agg(
        (F.count(F.lit(1)) - F.count_distinct(spec.key)).alias("duplicate_keys"),
        F.count_if(F.col(spec.position).isNull()).alias("null_positions"),
        F.count_if(null_metric).alias("null_metric_rows"))


def violations(tw: DataFrame, best: DataFrame, members: DataFrame, scenarios: DataFrame,
               profile: DataFrame, spec: ProfileSpec, bspec: BasketSpec,
               metrics: list[str]) -> DataFrame:
    """One row: every rule's violation count (all zero on valid output)."""
    a = twin_violations(tw, spec)
    b = basket_violations(best, members, scenarios, spec, bspec)
    c = input_violations(profile, spec, metrics)
    # three one-row aggregates side by side as scalar subqueries (no join)
    sa = a.select(F.struct(*a.columns).alias("s")).scalar()
    sb = b.select(F.struct(*b.columns).alias("s")).scalar()
    sc = c.select(F.struct(*c.columns).alias("s")).scalar()
    one = profile.sparkSession.range(1)
    return one.select(*[sa[x].alias(x) for x in a.columns],
                      *[sb[x].alias(x) for x in b.columns],
                      *[sc[x].alias(x) for x in c.columns])
