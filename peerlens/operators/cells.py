"""Equi-depth cells: a k-d split of every group of a table, as DataFrame jobs.

A round looks at all cells that still hold more than ``size`` rows: one
aggregate gives a cell's count, ranges and approximate medians, the widest
dimension (in units of the whole table's range) is cut at its median, and the
cell's rows go to one of two cells.  A cell of equal points is cut by a hash of
the key, so every cell ends within ``size`` rows, whatever the data.  The cuts
of a round are one row per ``size`` rows at most, which is what is broadcast;
rows are partially aggregated before they are shuffled, so a group that holds
a third of the table is no hot key.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peerlens.session import stored

ACCURACY = 200
SAMPLE = 64             # rows of a sample for each cell that a first split makes
FILLED = 0.75           # share of ``size`` that such a cell may be expected to hold


def first_split(df: DataFrame, group: str, dims: list[str], key: str, size: int) -> Column:
    """A column of cells for ``equi_depth`` to begin with: the groups above ``size``
    rows are cut, as deep as their count asks for, at the medians of ``SAMPLE`` rows
    for each cell.  The sample only places the cuts: cells that hold more than
    ``size`` rows after it are left to the rounds of ``equi_depth``."""
    spark = df.sparkSession
    counts = {r[0]: r[1] for r in df.groupBy(group).count().where(F.col("count") > size).collect()}
    if not counts:
        return F.lit("")
    deep = {g: int(np.ceil(np.log2(n / (FILLED * size)))) for g, n in counts.items()}
    span = 1 << 30
    share = spark.createDataFrame(
        [(g, int(min(1.0, SAMPLE * 2.0 ** deep[g] / n) * span)) for g, n in counts.items()],
        df.select(group).schema.add("_share", "long"))
    picked = (df.join(F.broadcast(share), group)
              .where(F.pmod(F.xxhash64(key, F.lit("cut")), F.lit(span)) < F.col("_share"))
              .select(group, *dims).toPandas())
    trees = {}
    for g, rows in picked.groupby(group):
        todo, cuts = [("", rows[dims].to_numpy(float))], {}
        while todo:
            name, x = todo.pop()
            if len(name) == deep[g] or len(x) < 2:
                continue
            d = int(np.ptp(x, axis=0).argmax())
            at = float(np.median(x[:, d]))
            above = x[:, d] > at
            if above.any():
                cuts[name] = d, at
                todo += [(name + "0", x[~above]), (name + "1", x[above])]
        trees[g] = cuts
    shared = spark.sparkContext.broadcast(trees)

    def place(groups: pd.Series, *columns: pd.Series) -> pd.Series:
        x = np.stack([c.to_numpy(float) for c in columns], 1)
        out = np.full(len(x), "", object)
        for g, rows in groups.groupby(groups).indices.items():
            todo = [("", rows)] if g in shared.value else []
            while todo:
                name, at = todo.pop()
                cut = shared.value[g].get(name)
                if cut is None:
                    out[at] = name
                    continue
                above = x[at, cut[0]] > cut[1]
                todo += [(name + "0", at[~above]), (name + "1", at[above])]
        return pd.Series(out)

    return F.pandas_udf(place, "string")(group, *dims)


def equi_depth(df: DataFrame, group: list[str], dims: list[str], key: str, size: int) -> DataFrame:
    """``df`` with a column ``cell`` (a string of cuts): at most ``size`` rows
    share a group and a cell.  ``dims`` are doubles without nulls.  A column
    ``cell`` that ``df`` has is split further."""
    def wide(d: str) -> str:
        return f"_w_{d}"

    scale: dict = {}
    out = df if "cell" in df.columns else df.withColumn("cell", F.lit(""))
    while True:
        held = out.groupBy(*group, "cell").count().where(F.col("count") > size).drop("count")
        held = stored(held, "crowded")
        if held.isEmpty():
            return out
        if not scale:
            ranges = df.agg(*[(F.max(d) - F.min(d)).alias(d) for d in dims]).first()
            scale = {d: ranges[d] or 1.0 for d in dims}
        cells = out.join(F.broadcast(held), [*group, "cell"]).groupBy(*group, "cell").agg(
            *[F.min(d).alias(f"_lo_{d}") for d in dims], *[F.max(d).alias(f"_hi_{d}") for d in dims],
            *[F.percentile_approx(d, 0.5, ACCURACY).alias(f"_mid_{d}") for d in dims])
        large = cells.select("*", *[((F.col(f"_hi_{d}") - F.col(f"_lo_{d}")) / F.lit(scale[d]))
                                    .alias(wide(d)) for d in dims])
        widest = F.greatest(*[F.col(wide(d)) for d in dims]) if len(dims) > 1 else F.col(wide(dims[0]))
        at = F.lit(-1)
        for i, d in reversed(list(enumerate(dims))):
            at = F.when((F.col(wide(d)) == widest) & (widest > 0), F.lit(i)).otherwise(at)

        def pick(prefix: str):
            e = F.lit(None).cast("double")
            for i, d in enumerate(dims):
                e = F.when(F.col("_at") == i, F.col(f"{prefix}{d}")).otherwise(e)
            return e

        cuts = large.withColumn("_at", at).select(
            *group, "cell", "_at", pick("_mid_").alias("_cut"),
            # a median that is the largest value goes to the upper cell
            (pick("_mid_") == pick("_hi_")).alias("_open"))
        x = F.lit(None).cast("double")
        for i, d in enumerate(dims):
            x = F.when(F.col("_at") == i, F.col(d)).otherwise(x)
        upper = (F.when(F.col("_at") == -1,
                        F.pmod(F.xxhash64(key, F.length("cell")), F.lit(2)) == 1)
                 .otherwise(F.when(F.col("_open"), x >= F.col("_cut")).otherwise(x > F.col("_cut"))))
        out = stored(out.join(F.broadcast(cuts), [*group, "cell"], "left")
                     .withColumn("cell", F.when(F.col("_at").isNull(), F.col("cell"))
                                 .otherwise(F.concat("cell", F.when(upper, "1").otherwise("0"))))
                     .drop("_at", "_cut", "_open"), "cells")
