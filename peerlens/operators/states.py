"""Mergeable states: moments and percentiles kept up to date without the history.

A moment state is a row per group and feature (n, mean, sum of squared
deviations); a histogram state a row per feature, group and value with its
count.  States of new rows are merged with stored ones by one aggregate, in
any order and any number at once, and give what a pass over all rows gives."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peerlens.functions import round_half_even
from peerlens.operators.normalize import running_counts


# ------------------------------------------------------------------ moments
def moment_state(df: DataFrame, group: list[str], features: list[str]) -> DataFrame:
    """(group, feature, n, mean, m2) of the non-null values (A1)."""
    long = df.select(*group, F.explode(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features
    ])).alias("_f")).select(*group, "_f.*").where(F.col("x").isNotNull())
    return long.groupBy(*group, "feature").agg(
        F.count("x").alias("n"), F.avg("x").alias("mean"),
        (F.coalesce(F.var_pop("x"), F.lit(0.0)) * F.count("x")).alias("m2"))


def merge_moments(group: list[str], *states: DataFrame) -> DataFrame:
    """The state of all rows: means weighted by counts, and the squares of the
    parts plus those of their means around the whole mean (Chan)."""
    every = reduce(DataFrame.unionByName, states)
    parts = F.collect_list(F.struct("n", "mean", "m2"))     # one entry per state merged
    whole = every.groupBy(*group, "feature").agg(
        F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("mean"),
        parts.alias("_parts"))
    m2 = F.aggregate("_parts", F.lit(0.0), lambda acc, p: acc + p["m2"] + p["n"] * (
        p["mean"] - F.col("mean")) * (p["mean"] - F.col("mean")))
    return whole.select(*group, "feature", "n", "mean", m2.alias("m2"))


def remove_rows(state: DataFrame, gone: DataFrame, group: list[str]) -> DataFrame:
    """``state`` without the rows that the state ``gone`` describes."""
    g = gone.select(*group, "feature", F.col("n").alias("_n"), F.col("mean").alias("_mean"),
                    F.col("m2").alias("_m2"))
    n0 = F.coalesce(F.col("_n"), F.lit(0))
    left = F.col("n") - n0
    mean = F.when(n0 == 0, F.col("mean")).otherwise(
        (F.col("n") * F.col("mean") - n0 * F.col("_mean")) / F.when(left > 0, left))
    d = F.col("_mean") - F.col("mean")
    m2 = F.when(n0 == 0, F.col("m2")).otherwise(F.greatest(F.lit(0.0), (
        F.col("m2") - F.col("_m2") - n0 * F.col("n") / F.when(left > 0, left) * d * d)))
    return (state.join(g, [*group, "feature"], "left").where(left > 0)
            .select(*group, "feature", left.alias("n"), mean.alias("mean"), m2.alias("m2")))


def std_pop() -> Column:
    """Population standard deviation of a moment state."""
    return F.sqrt(F.col("m2") / F.col("n"))


# --------------------------------------------------------------- histograms
def histogram_state(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """(group, value, c): how often each non-null value occurs."""
    return (df.where(F.col(value).isNotNull()).groupBy(*group, F.col(value).alias("value"))
            .agg(F.count(F.lit(1)).alias("c")))


def merge_histograms(group: list[str], *states: DataFrame) -> DataFrame:
    return (reduce(DataFrame.unionByName, states).groupBy(*group, "value")
            .agg(F.sum("c").alias("c")))


def percentiles_of(state: DataFrame, group: list[str]) -> DataFrame:
    """(group, value, n, average_pct, strict_pct): the average-rank percentile and
    the share strictly below (one decimal) of every value of a histogram state."""
    ranked = running_counts(state, group, "value", "c")
    below = F.col("cum") - F.col("c")
    return ranked.select(
        *group, "value", "n",
        round_half_even((F.col("cum") - (F.col("c") - 1) / F.lit(2.0)) / F.col("n") * F.lit(100.0), 1)
        .alias("average_pct"),
        round_half_even(below / F.col("n") * F.lit(100.0), 1).alias("strict_pct"))
