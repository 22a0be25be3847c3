"""Recommender evaluation (C15): precision@k and MRR against tags.

Per query: compatible peers are counted in the exact position (self
excluded); queries with none are skipped; eval_k = min(k, n_compat); the
twins come from the cohort pool; hits are compatible twins among the first
eval_k; reciprocal rank is 1 / rank of the first hit (0 without one).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peerlens.dims import PASS_THRESHOLD_PCT, Dimensions
from peerlens.operators.tags import compat_counts, compat_flags, with_tags
from peerlens.operators.twins import twins
from peerlens.schemas import ProfileSpec


def per_query(profile: DataFrame, dims: Dimensions, spec: ProfileSpec, k: int = 3,
              secondary: DataFrame | None = None) -> DataFrame:
    tagged = with_tags(profile, dims, spec, secondary)
    counts = compat_counts(tagged, spec).select(
        F.col(spec.key).alias("ref_key"), "n_compat")
    queries = profile.select(F.col(spec.name).alias("reference"), F.lit(k).alias("top_n"))
    tw = twins(profile, dims, spec, queries, strict_position=False, display=False, top_n_bound=k)
    flagged = compat_flags(tw.select("ref_key", spec.key, "rank"), tagged, spec)
    j = flagged.join(counts.where(F.col("n_compat") > 0), "ref_key")
    eval_k = F.least(F.lit(k), F.col("n_compat"))
    in_k = F.col("rank") <= eval_k
    hit = in_k & F.col("compatible")
    return j.groupBy("ref_key").agg(
        F.first("n_compat").alias("n_compat"),
        F.least(F.lit(k), F.first("n_compat")).alias("eval_k"),
        F.count_if(hit).alias("hits"),
        F.min(F.when(hit, F.col("rank"))).alias("first_hit_rank")).select(
        "ref_key", "n_compat", "eval_k", "hits",
        (F.col("hits") / F.col("eval_k")).alias("precision"),
        F.coalesce(F.lit(1.0) / F.col("first_hit_rank"), F.lit(0.0)).alias("reciprocal_rank"))


def evaluate(profile: DataFrame, dims: Dimensions, spec: ProfileSpec, k: int = 3,
             secondary: DataFrame | None = None,
             threshold_pct: float = PASS_THRESHOLD_PCT) -> DataFrame:
    """One row: evaluated, total, precision_pct, mrr, verdict."""
    pq = per_query(profile, dims, spec, k, secondary)
    total = profile.agg(F.count(F.lit(1)).alias("total"))
    summary = pq.agg(F.count(F.lit(1)).alias("evaluated"),
                     (F.avg("precision") * F.lit(100.0)).alias("precision_pct"),
                     F.avg("reciprocal_rank").alias("mrr"))
    s = summary.select("*", total.scalar().alias("total"))
    return s.select(
        F.lit(k).alias("k"), "evaluated", "total", "precision_pct", "mrr",
        F.when(F.col("precision_pct") >= F.lit(threshold_pct), F.lit("PASS"))
         .otherwise(F.lit("NEEDS TUNING")).alias("verdict"))
