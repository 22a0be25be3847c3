"""Normalisation operators: volume filter, percentile ranks, min-max scaling,
cohort moments / weighted z-scores and peer percentiles.

Percentiles never use an unpartitioned window (that plans ``Exchange
SinglePartition``).  They are computed from a value histogram with a
distributed prefix sum: range-partition the histogram, take running sums
inside each range partition, and add per-partition offsets computed from
a tiny (groups x partitions) table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peerlens.dims import Dimensions
from peerlens.functions import round_half_even
from peerlens.schemas import ProfileSpec
from peerlens.session import stored

EPS = 2.220446049250313e-16  # float64 machine epsilon


# ---------------------------------------------------------------- P11 / A8
def min_volume(df: DataFrame, column: str, minimum: float) -> DataFrame:
    """Keep rows whose volume column is at least ``minimum`` (inclusive)."""
    return df.where(F.col(column) >= F.lit(minimum))


def volume_counts(df: DataFrame, column: str, minimum: float) -> DataFrame:
    """One row: rows loaded and rows meeting the volume floor."""
    return df.agg(F.count(F.lit(1)).alias("rows_loaded"),
                  F.count_if(F.col(column) >= F.lit(minimum)).alias("rows_qualified"))


# ---------------------------------------------------------- prefix sums
def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def running_counts(hist: DataFrame, groups: list[str], value: str,
                   count: str = "c") -> DataFrame:
    """Add ``cum`` (inclusive running sum of ``count`` ordered by ``value``
    within ``groups``) and ``n`` (group total) to a histogram.

    Scales with the number of distinct values: no task ever holds a whole
    group; one hot value is already a single histogram row."""
    nparts = _partitions(hist)
    # The boundaries of a range partitioning are sampled anew by every reader,
    # so the ranged histogram is stored once and both branches read that.
    ranged = stored(hist.repartitionByRange(nparts, *groups, value)
                    .withColumn("_pid", F.spark_partition_id()), "ranged-histogram")
    w_local = (Window.partitionBy("_pid", *groups).orderBy(value)
               .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    local = ranged.withColumn("_lcum", F.sum(count).over(w_local))
    per_part = local.groupBy(*groups, "_pid").agg(F.sum(count).alias("_pc"))
    w_off = (Window.partitionBy(*groups).orderBy("_pid")
             .rowsBetween(Window.unboundedPreceding, -1))
    offsets = (per_part
               .withColumn("_off", F.coalesce(F.sum("_pc").over(w_off), F.lit(0)))
               .withColumn("n", F.sum("_pc").over(Window.partitionBy(*groups)))
               .drop("_pc"))
    return (local.join(offsets, [*groups, "_pid"])
            .withColumn("cum", F.col("_lcum") + F.col("_off"))
            .drop("_pid", "_lcum", "_off"))


def _long(df: DataFrame, keep: list[str], metrics: list[str]) -> DataFrame:
    kv = F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"))
        for m in metrics]))
    return df.select(*keep, kv.alias("_kv")).select(*keep, "_kv.metric", "_kv.value")


# ---------------------------------------------------------------- W1
def percentile_rank(df: DataFrame, metrics: list[str], partition_by: list[str] | None = None,
                    suffix: str = "_percentile", digits: int = 1,
                    key: str | None = None) -> DataFrame:
    """Average-rank percentile of each metric, x100, rounded half-even.

    Ties share the average of their ranks; nulls stay null and do not count
    in n.  Adds ``{metric}{suffix}`` columns.  With a unique ``key`` and
    several metrics, the percentiles go back through one long-form join and
    one pivot instead of one join of the wide table per metric."""
    pb = list(partition_by or [])
    if key is not None and len(metrics) > 1:
        return _percentile_rank_keyed(df, metrics, pb, suffix, digits, key)
    long = _long(df, pb, metrics).where(F.col("value").isNotNull())
    hist = long.groupBy(*pb, "metric", "value").agg(F.count(F.lit(1)).alias("c"))
    ranked = running_counts(hist, [*pb, "metric"], "value")
    avg_rank = F.col("cum") - (F.col("c") - F.lit(1)) / F.lit(2.0)
    ranked = ranked.select(
        *pb, "metric", "value",
        round_half_even(avg_rank / F.col("n") * F.lit(100.0), digits).alias("_pct"))
    out = df
    for m in metrics:
        r = ranked.where(F.col("metric") == F.lit(m)).select(
            *[F.col(p).alias(f"_p_{p}") for p in pb],
            F.col("value").alias("_v"), F.col("_pct").alias(f"{m}{suffix}"))
        cond = [out[m].cast("double") == r["_v"]] + [out[p] == r[f"_p_{p}"] for p in pb]
        out = out.join(r, cond, "left").drop("_v", *[f"_p_{p}" for p in pb])
    return out


def _percentile_rank_keyed(df, metrics, pb, suffix, digits, key):
    long = _long(df, [key, *pb], metrics).where(F.col("value").isNotNull())
    hist = long.groupBy(*pb, "metric", "value").agg(F.count(F.lit(1)).alias("c"))
    ranked = running_counts(hist, [*pb, "metric"], "value")
    avg_rank = F.col("cum") - (F.col("c") - F.lit(1)) / F.lit(2.0)
    ranked = ranked.select(*pb, "metric", "value",
                           round_half_even(avg_rank / F.col("n") * F.lit(100.0), digits).alias("_pct"))
    per_key = (long.join(ranked, [*pb, "metric", "value"])
               .groupBy(key).agg(*[F.max(F.when(F.col("metric") == F.lit(m), F.col("_pct")))
                                    .alias(f"{m}{suffix}") for m in metrics]))
    return df.join(per_key, key, "left")


# ---------------------------------------------------------------- A2
def minmax_scale(df: DataFrame, metrics: list[str], suffix: str = "_scaled") -> DataFrame:
    """(x - min) / (max - min) per column; a (near) zero range gives 0.

    The global min/max are one aggregate row injected as a scalar
    subquery: no join, no single-partition window."""
    stats = df.agg(F.struct(*[
        e for i, m in enumerate(metrics)
        for e in (F.min(F.col(m).cast("double")).alias(f"mn{i}"),
                  F.max(F.col(m).cast("double")).alias(f"mx{i}"))])).scalar()
    cols = []
    for i, m in enumerate(metrics):
        mn, mx = stats.getField(f"mn{i}"), stats.getField(f"mx{i}")
        rng = mx - mn
        cols.append(F.when(rng < F.lit(10 * EPS), F.lit(0.0))
                    .otherwise((F.col(m).cast("double") - mn) / rng).alias(f"{m}{suffix}"))
    return df.select("*", *cols)


# ------------------------------------------------------- cohort vectors
def with_cohort(df: DataFrame, dims: Dimensions, spec: ProfileSpec) -> DataFrame:
    """``cohort`` (default when unmapped), its index and a ``mapped`` flag."""
    midx = dims.mapped_cohort_index(F.col(spec.position))
    default = F.lit(dims.cohort_ids[dims.default_cohort])
    return (df.withColumn("mapped", midx.isNotNull())
              .withColumn("cohort_idx", F.coalesce(midx, default))
              .withColumn("cohort", dims.cohort_name(F.col("cohort_idx"))))


def slot_columns(dims: Dimensions, idx: Column, prefix: str = "x") -> list[Column]:
    return [dims.slot(idx, j).alias(f"{prefix}{j + 1}") for j in range(dims.n_slots)]


def with_slots(df: DataFrame, dims: Dimensions, idx_col: str = "cohort_idx") -> DataFrame:
    """Metric slots x1..xM in the cohort's feature order (0 for unused
    slots), the feature count ``m`` and a ``valid`` flag (no null metric)."""
    idx = F.col(idx_col)
    out = df.select("*", *slot_columns(dims, idx), dims.n_features(idx).alias("m"))
    valid = F.lit(True)
    for j in range(dims.n_slots):
        valid = valid & F.col(f"x{j + 1}").isNotNull()
    return out.withColumn("valid", valid)


def cohort_moments(slots: DataFrame, dims: Dimensions, pool_col: str) -> DataFrame:
    """A1: per-pool count, mean and population std of every slot.

    Computed in long form (one ``explode`` of the slots, then
    ``groupBy(pool, ord)``) so every aggregate reads a plain column, then
    folded back to one row per pool (pools x slots rows: tiny)."""
    m = dims.n_slots
    arr = F.array(*[F.struct(F.lit(j).alias("ord"), F.col(f"x{j}").alias("v"))
                    for j in range(1, m + 1)])
    long = (slots.where("valid").select(pool_col, F.explode(arr).alias("_e"))
            .select(pool_col, F.col("_e.ord").alias("ord"), F.col("_e.v").alias("v")))
    per = long.groupBy(pool_col, "ord").agg(F.count(F.lit(1)).alias("n"),
                                            F.avg("v").alias("mu"),
                                            F.stddev_pop("v").alias("sd"))
    aggs = [F.max("n").alias("n")]
    for j in range(1, m + 1):
        aggs += [F.max(F.when(F.col("ord") == j, F.col("mu"))).alias(f"mu{j}"),
                 F.max(F.when(F.col("ord") == j, F.col("sd"))).alias(f"sd{j}")]
    return per.groupBy(pool_col).agg(*aggs)


def guarded_scale(sd: Column, mu: Column) -> Column:
    """Population std, or 1 when it is zero up to floating-point noise."""
    return (F.when(sd.isNull() | (sd <= F.lit(1e-12) * F.greatest(F.abs(mu), F.lit(1.0))),
                   F.lit(1.0)).otherwise(sd))


def zscore_cohort(df: DataFrame, dims: Dimensions, spec: ProfileSpec,
                  digits: int = 4) -> DataFrame:
    """Weighted z-score slots ``z1..zM`` = sqrt(w) (x - mu) / sd within the
    cohort of mapped rows (P3 + A1).  Unmapped rows are scored against the
    default cohort's moments; rows with a null metric get null slots."""
    slots = with_slots(with_cohort(df, dims, spec), dims)
    moments = cohort_moments(slots.where("mapped"), dims, "cohort")
    joined = slots.join(F.broadcast(moments), "cohort", "left")
    zs = []
    for j in range(1, dims.n_slots + 1):
        s = guarded_scale(F.col(f"sd{j}"), F.col(f"mu{j}"))
        w = dims.slot(F.col("cohort_idx"), j - 1, "weight")
        z = F.sqrt(w) * (F.col(f"x{j}") - F.col(f"mu{j}")) / s
        zs.append(F.when(F.col("valid") & F.col("n").isNotNull(),
                         round_half_even(z, digits)).alias(f"z{j}"))
    return joined.select(spec.key, "cohort", "mapped", *zs)


# ---------------------------------------------------------------- W2
def _slot_long(df: DataFrame, keep: list[str], dims: Dimensions) -> DataFrame:
    arr = F.array(*[F.col(f"x{j}") for j in range(1, dims.n_slots + 1)])
    return (df.select(*keep, F.posexplode(F.slice(arr, 1, F.col("m"))).alias("pos", "value"))
              .withColumn("ord", F.col("pos") + 1).drop("pos"))


def peer_percentiles(pool: DataFrame, probes: DataFrame, dims: Dimensions,
                     probe_keys: list[str], digits: int = 1) -> DataFrame:
    """Share of pool rows strictly below each probe value, x100.

    ``pool``: rows with ``cohort`` + slots (the peers).  ``probes``: rows
    with ``probe_keys``, ``cohort`` (whose features to use) and slots.
    A probe's own row counts in n only if it is in the pool.  Output is
    long: probe_keys, cohort, ord, value, n, below, pct."""
    pool_long = _slot_long(pool.where("valid"), ["cohort"], dims).withColumn("c", F.lit(1))
    probe_long = _slot_long(probes.where("valid"), [*probe_keys, "cohort"], dims)
    hist = (pool_long.unionByName(
                probe_long.select("cohort", "value", "ord", F.lit(0).alias("c")))
            .groupBy("cohort", "ord", "value").agg(F.sum("c").alias("c")))
    ranked = running_counts(hist, ["cohort", "ord"], "value")
    below = F.col("cum") - F.col("c")
    pct = F.when(F.col("n") > 0,
                 round_half_even(below / F.col("n") * F.lit(100.0), digits))
    ranked = ranked.select("cohort", "ord", "value", "n", below.alias("below"), pct.alias("pct"))
    return probe_long.join(ranked, ["cohort", "ord", "value"], "left")


# ---------------------------------------------------------------- C3 / J9
def feature_table(df: DataFrame, metrics: list[str], volume_col: str,
                  min_volume_value: float, key: str | None = None) -> DataFrame:
    """Volume floor, then ``{m}_percentile`` (W1) and ``{m}_scaled`` (A2)
    for every metric, side by side in one plan (no positional concat)."""
    kept = min_volume(df, volume_col, min_volume_value)
    return minmax_scale(percentile_rank(kept, metrics, key=key), metrics)
