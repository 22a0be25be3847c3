"""Connected components of an edge table, by alternating large-star and
small-star rounds (every node points to the smallest node it knows).

A round is an aggregation (combined in the tasks before its shuffle) and a
join on node ids; no task holds a component or a node's neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from peerlens.session import stored

MAX_ROUNDS = 60         # far beyond the logarithmic bound; more is an error


def _large_star(e: DataFrame) -> DataFrame:
    """Larger neighbours of every node point to the smallest of its neighbourhood."""
    both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    out = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.where("u <> v").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours point to the smallest of them."""
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    others = e.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return others.union(least.select("u", F.col("m").alias("v"))).distinct()


def _kept(e: DataFrame) -> tuple[DataFrame, tuple]:
    """The stored edges with their number and checksum, taken while writing."""
    seen = Observation()
    marks = F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum")
    e = stored(e.observe(seen, *marks), "edges")
    return e, (seen.get["n"], seen.get["sum"])


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (columns a, b); the
    component is its smallest node."""
    e, mark = _kept(edges.where("a <> b").select(F.greatest("a", "b").alias("u"),
                                                 F.least("a", "b").alias("v")).distinct())
    for _ in range(MAX_ROUNDS):
        if not mark[0]:
            break
        e, now = _kept(_small_star(_large_star(e)))
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
