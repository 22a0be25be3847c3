"""A stored twin index: one search reads one pool.

``build`` writes, from one pass over the profiles, (1) the rows of every pool,
by cohort and by position, with their metric slots, partitioned by pool, (2) the
rows by name, partitioned by a hash of the lower-cased name, and (3) the pools'
moments.  ``TwinIndex.search`` then looks up the reference in one name partition,
its pool's moments in a table of a row per pool, and scores the rows of one pool
partition, with the reference's values as literals: no profile is built, no
other pool is read, and the best rows are taken without a shuffle.  A new index
is written beside the old one; searches go on until they are handed the new one.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from peerlens.dims import Dimensions
from peerlens.operators.normalize import cohort_moments
from peerlens.operators.twins import _score, prepare
from peerlens.schemas import ProfileSpec
from peerlens.session import materialize, shared_path

NAME_PARTS = 64


def _scale(sd: float | None, mu: float) -> float:
    """``normalize.guarded_scale`` of one value."""
    return 1.0 if sd is None or sd <= 1e-12 * max(abs(mu), 1.0) else sd


class TwinIndex(NamedTuple):
    path: str
    dims: Dimensions
    spec: ProfileSpec

    def _table(self, spark: SparkSession, name: str) -> DataFrame:
        return spark.read.parquet(f"{self.path}/{name}")

    def _factors(self, ref: Row, moments: Row | None, own: bool) -> list[float]:
        """w / s^2 of every slot; a reference of no mapped position joins the
        moments of the default cohort (Chan's update)."""
        weights = [w for _, w, _ in self.dims.role_metrics[ref["cohort_idx"]][1]]
        out = []
        for j in range(1, self.dims.n_slots + 1):
            n = float(moments["n"]) if moments else 0.0
            x = float(ref[f"x{j}"])
            mu, sd = (moments[f"mu{j}"], moments[f"sd{j}"]) if moments else (None, None)
            if not own:
                mu, sd = x if mu is None else mu, 0.0 if sd is None else sd
                d = x - mu
                grown = mu + d / (n + 1)
                sd = math.sqrt(max(n * sd * sd + d * (x - grown), 0.0) / (n + 1))
                mu = grown
            s = _scale(sd, mu if mu is not None else 0.0)
            out.append((weights[j - 1] if j <= len(weights) else 0.0) / (s * s))
        return out

    def _nothing(self, spark: SparkSession) -> DataFrame:
        """The answer of ``search`` without rows."""
        spec = self.spec
        show = list(dict.fromkeys([spec.key, *spec.display()]))
        names = self._table(spark, "names").where(F.lit(False))
        return names.select(F.col(spec.key).alias("ref_key"), "cohort", *show,
                            F.lit(0.0).alias("similarity_score"), F.lit(1).alias("rank"))

    def search(self, spark: SparkSession, reference: str, max_age: int | None = None,
               selected_leagues: list[str] | None = None, strict_position: bool = False,
               top_n: int = 5, require_match: bool = True) -> DataFrame:
        """ref_key, cohort, the candidate's display columns, similarity_score and
        rank: the rows of ``twins`` for one query.  An unknown reference raises
        ``ValueError``, or gives no rows without ``require_match``."""
        spec = self.spec
        lower = F.lower(F.lit(reference))
        part = spark.range(1).select(F.pmod(F.xxhash64(lower), F.lit(NAME_PARTS)), lower).first()
        found = (self._table(spark, "names").where((F.col("part") == int(part[0]))
                                                   & (F.col("lower_name") == part[1])).limit(1).collect())
        if not found and require_match:
            raise ValueError(f"no profile is named {reference}")
        if not found:
            return self._nothing(spark)
        ref = found[0]
        own = strict_position or ref["mapped"]
        pool = f"p|{ref[spec.position]}" if strict_position else f"c|{ref['cohort']}"
        moments = self._table(spark, "moments").where(F.col("pool") == pool).first()
        rows = self._table(spark, "pools").where((F.col("pool") == pool)
                                                 & (F.col(spec.key) != F.lit(ref[spec.key])))
        if max_age is not None:
            rows = rows.where(F.col(spec.age) <= max_age)
        if selected_leagues:
            rows = rows.where(F.col(spec.league).isin(list(selected_leagues)))
        n = self.dims.n_slots
        factors = self._factors(ref, moments, own)
        show = list(dict.fromkeys([spec.key, *spec.display()]))
        scored = rows.select(*show, *[f"x{j}" for j in range(1, n + 1)],
                             F.lit(int(ref["m"])).alias("m"),
                             *[F.lit(float(ref[f"x{j}"])).alias(f"qx{j}") for j in range(1, n + 1)],
                             *[F.lit(f).alias(f"k{j}") for j, f in enumerate(factors, 1)])
        best = (scored.select(*show, _score(n).alias("similarity_score"))
                .orderBy(F.desc("similarity_score"), spec.key).limit(top_n))
        # top_n rows: their places
        order = F.sort_array(F.collect_list(F.struct(
            (-F.col("similarity_score")).alias("s"), F.col(spec.key).alias("k"),
            F.struct("similarity_score", *show).alias("row"))))
        return best.agg(order.alias("all")).select(F.posexplode("all").alias("at", "one")).select(
            F.lit(ref[spec.key]).alias("ref_key"), F.lit(ref["cohort"]).alias("cohort"),
            *[F.col(f"one.row.{c}").alias(c) for c in (*show, "similarity_score")],
            (F.col("at") + 1).alias("rank"))


def build(profile: DataFrame, dims: Dimensions, spec: ProfileSpec, path: str | None = None) -> TwinIndex:
    """Write the index of ``profile`` (rows with a null metric are not in it)."""
    path = path or shared_path(profile.sparkSession, "twin-index")
    base = materialize(prepare(profile, dims, spec).where("valid"))
    show = list(dict.fromkeys([spec.key, *spec.display()]))
    slots = [f"x{j}" for j in range(1, dims.n_slots + 1)]
    pools = (base.where("mapped").select(F.concat(F.lit("c|"), "cohort").alias("pool"), *show, *slots)
             .unionByName(base.where(F.col(spec.position).isNotNull()).select(
                 F.concat(F.lit("p|"), F.col(spec.position)).alias("pool"), *show, *slots)))
    # a pool's rows come together, in several tasks and files where they are many
    pools.hint("rebalance", F.col("pool")).write.partitionBy("pool").parquet(f"{path}/pools")
    pools = profile.sparkSession.read.parquet(f"{path}/pools")
    cohort_moments(pools.withColumn("valid", F.lit(True)), dims, "pool").write.parquet(f"{path}/moments")
    lower = F.lower(F.col(spec.name))
    (base.select(*show, *slots, "cohort", "cohort_idx", "mapped", "m", lower.alias("lower_name"),
                 F.pmod(F.xxhash64(lower), F.lit(NAME_PARTS)).cast("int").alias("part"))
     .hint("rebalance", F.col("part")).write.partitionBy("part").parquet(f"{path}/names"))
    return TwinIndex(path, dims, spec)
