"""Twins over array-valued features (C2 on vectors, unit weights).

Same kernel as ``twins`` with m = vector length: per (cohort, dimension)
population std from a ``posexplode`` + ``groupBy`` (cohorts x dims rows),
folded back into one scale array per cohort, then
d2 = sum_j (a_j - b_j)^2 / s_j^2.  A cohort's rows are dealt in chunks, every
query meets every chunk of its cohort (coordinate or pivot bounds do not prune
exactly in high dimension, see README), and tasks score blocks of queries with
array operations (``near``); the local winners are merged per query.  Equal
vectors collapse to the k + 1 smallest keys.

Vectors shorter than their cohort's longest, or with a null component, have a
null score with every row: they rank last, by key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from peerlens.operators.near import BLOCK_QUERIES, group_top
from peerlens.operators.normalize import guarded_scale
from peerlens.operators.twins import DEFAULT_PAIR_BUDGET, EXHAUSTIVE_POOL
from peerlens.session import materialize

CHUNK_ROWS = 16_384         # candidates of a chunk, about


def vector_twins(df: DataFrame, key: str, vector: str, cohort: str, top_n: int = 5,
                 pair_budget: int = DEFAULT_PAIR_BUDGET, sample: int = 64,
                 exhaustive_label: int = EXHAUSTIVE_POOL, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """ref_key, cohort, cand_key, similarity_score and rank: every row's ``top_n``
    nearest rows of its cohort.  A cohort of at most ``exhaustive_label`` rows is
    one chunk; ``sample`` has no use any more."""
    v = df.select(F.col(key).alias("key"), F.col(cohort).alias("cohort"),
                  F.transform(vector, lambda x: x.cast("double")).alias("vec"))
    v = materialize(v.where(F.col("vec").isNotNull() & F.col("cohort").isNotNull() & F.col("key").isNotNull())
                    .withColumn("_q", F.monotonically_increasing_id()))
    long = v.select("cohort", F.posexplode("vec").alias("d", "x"))
    mom = long.groupBy("cohort", "d").agg(F.avg("x").alias("mu"), F.stddev_pop("x").alias("sd"))
    scale = guarded_scale(F.col("sd"), F.col("mu"))
    inv = (mom.select("cohort", F.struct("d", (F.lit(1.0) / (scale * scale)).alias("k")).alias("dk"))
              .groupBy("cohort").agg(F.sort_array(F.collect_list("dk")).alias("dks"))
              .select("cohort", F.transform("dks", lambda e: e["k"]).alias("k")))
    sizes = v.groupBy("cohort").agg(F.count(F.lit(1)).alias("n"))
    inv = materialize(inv.join(sizes, "cohort").select("cohort", "k", F.when(
        F.col("n") > F.lit(exhaustive_label), F.ceil(F.col("n") / F.lit(float(chunk_rows))))
        .otherwise(F.lit(1)).cast("int").alias("chunks")))
    # inv has one row per cohort: no hint (cohorts are data here); it is
    # broadcast when it is small.
    whole = (F.size("vec") == F.size("k")) & ~F.exists("vec", lambda x: x.isNull())
    rows = v.join(inv, "cohort").withColumn("whole", whole)
    alike = Window.partitionBy("cohort", "vec").orderBy("key")
    again = Window.partitionBy("cohort", "vec", "key").orderBy("key")
    cands = (rows.where("whole").select("cohort", "vec", "key", "chunks")
             .withColumn("_d", F.dense_rank().over(alike)).where(F.col("_d") <= F.lit(top_n + 1))
             .withColumn("_r", F.row_number().over(again)).where(F.col("_r") <= F.lit(top_n))
             .select("cohort", F.pmod(F.xxhash64("key"), F.col("chunks")).cast("int").alias("chunk"),
                     F.col("key").alias("_ck"), F.lit(None).cast("int").alias("_cage"),
                     F.lit(None).cast("string").alias("_clg"), F.col("vec").alias("x")))
    asked = rows.where("whole").select(
        "cohort", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "_q",
        F.col("key").alias("_rk"), F.lit(top_n).alias("top_n"), F.lit(None).cast("double").alias("max_age"),
        F.lit(None).cast("array<string>").alias("selected_leagues"), F.size("vec").alias("m"),
        F.col("vec").alias("qx"), "k", F.lit(None).cast("double").alias("r2"))
    found = group_top(materialize(cands), asked, ["cohort", "chunk"],
                      max(1, min(BLOCK_QUERIES, pair_budget // 244)))
    # pairs without a score: of any row with one that is not whole
    first = Window.partitionBy("cohort", "whole").orderBy("_ck")
    few = (rows.select("cohort", "whole", F.col("key").alias("_ck"))
           .withColumn("_d", F.dense_rank().over(first)).where(F.col("_d") <= F.lit(top_n + 1))
           .withColumn("_r", F.row_number().over(Window.partitionBy("cohort", "whole", "_ck").orderBy("_ck")))
           .where(F.col("_r") <= F.lit(top_n)))
    unscored = (rows.select("cohort", "_q", F.col("key").alias("_rk"), F.col("whole").alias("_w"))
                .join(few, "cohort")
                .where(~(F.col("whole") & F.col("_w")) & (F.col("_ck") != F.col("_rk")))
                .select("_q", "_ck", F.lit(None).cast("double").alias("similarity_score")))
    w = Window.partitionBy("ref_key", "cohort").orderBy(F.col("similarity_score").desc(), F.col("cand_key").asc())
    return (found.unionByName(unscored).join(v.select("_q", F.col("key").alias("ref_key"), "cohort"), "_q")
            .withColumnRenamed("_ck", "cand_key")
            .withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= F.lit(top_n))
            .select("ref_key", "cohort", "cand_key", "similarity_score", "rank"))
