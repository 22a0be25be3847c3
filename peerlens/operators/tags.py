"""Tactical tags and compatibility.

Compatible-peer counts work on the distinct tag sets of a position, so
neither rows nor the size of a tag set make pairs or subsets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peerlens.dims import Dimensions
from peerlens.schemas import ProfileSpec


def secondary_table(spark, dims: Dimensions) -> DataFrame:
    return dims.hybrid_family_df(spark)


def with_tags(df: DataFrame, dims: Dimensions, spec: ProfileSpec,
              secondary: DataFrame | None = None) -> DataFrame:
    """``tags``: sorted distinct array of the primary family (mapped role or
    the raw role, J3) and the secondary families of the key (J4, U2)."""
    primary = F.array(dims.family(F.col(spec.role)))
    if secondary is None:
        if not dims.hybrid_family:
            return df.withColumn("tags", F.array_sort(F.array_distinct(primary)))
        secondary = dims.hybrid_family_df(df.sparkSession)
    sec = secondary.groupBy(F.col("key").alias("_skey")).agg(
        F.collect_set("family").alias("_sec"))
    j = df.join(sec, df[spec.key] == sec["_skey"], "left")
    tags = F.array_sort(F.array_union(primary, F.coalesce(F.col("_sec"), F.array().cast("array<string>"))))
    return j.withColumn("tags", tags).drop("_skey", "_sec")


def compat_counts(tagged: DataFrame, spec: ProfileSpec) -> DataFrame:
    """(key, position, n_compat): same-position peers (self excluded) whose
    tag set overlaps the row's (A5 over J7).

    Rows never pair up: the distinct tag sets of a position are counted, sets
    that share a tag are found by a join on the tag, and a row's count is the
    sum over the sets that overlap its own.  A row without tags has none."""
    t = tagged.select(spec.key, spec.position,
                      F.array_sort(F.array_distinct("tags")).alias("_tags"))
    sets = t.groupBy(spec.position, "_tags").agg(F.count(F.lit(1)).alias("_cnt"))
    own = sets.select(spec.position, "_tags", F.explode("_tags").alias("_tag"))
    other = sets.select(spec.position, F.col("_tags").alias("_other"), "_cnt",
                        F.explode("_tags").alias("_tag"))
    overlap = (own.join(other, [spec.position, "_tag"])
               .select(spec.position, "_tags", "_other", "_cnt").distinct()
               .groupBy(spec.position, "_tags").agg((F.sum("_cnt") - 1).alias("n_compat")))
    return (t.where(F.col(spec.position).isNotNull())
            .join(overlap, [spec.position, "_tags"], "left")
            .select(spec.key, spec.position,
                    F.coalesce("n_compat", F.lit(0)).cast("long").alias("n_compat")))


def compat_flags(pairs: DataFrame, tagged: DataFrame, spec: ProfileSpec,
                 left: str = "ref_key", right: str | None = None) -> DataFrame:
    """Add ``compatible`` (arrays_overlap of the two tag sets, U3) to a
    pair table, e.g. twins output (query, candidate)."""
    right = right or spec.key
    tl = tagged.select(F.col(spec.key).alias("_lk"), F.col("tags").alias("ref_tags"))
    tr = tagged.select(F.col(spec.key).alias("_rk"), F.col("tags").alias("cand_tags"))
    j = pairs.join(tl, pairs[left] == tl["_lk"]).join(tr, F.col(right) == tr["_rk"])
    return j.withColumn("compatible", F.arrays_overlap("ref_tags", "cand_tags")).drop("_lk", "_rk")
