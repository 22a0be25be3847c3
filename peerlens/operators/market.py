"""Market enrichment (J2/C13) and composite tactical value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peerlens.schemas import BasketSpec


def enrich_market(players: DataFrame, market: DataFrame, key: str, bspec: BasketSpec,
                  defaults: tuple = (30.0, 60.0, 3, 1.10), market_key: str | None = None
                  ) -> DataFrame:
    """Left-join fee / wage / contract / resale by key, defaults when absent.

    The market table is data (unbounded), so no broadcast hint: AQE turns
    the join into a broadcast at run time when the market side is small."""
    mk = market_key or key
    fee, wage, years, resale = defaults
    m = market.select(F.col(mk).alias("_mkey"),
                      F.col(bspec.fee).alias("_fee"), F.col(bspec.wage).alias("_wage"),
                      F.col(bspec.contract).alias("_years"), F.col(bspec.resale).alias("_resale"))
    j = players.join(m, players[key] == m["_mkey"], "left")
    return j.select(
        *[players[c] for c in players.columns],
        F.coalesce(F.col("_fee"), F.lit(float(fee))).alias(bspec.fee),
        F.coalesce(F.col("_wage"), F.lit(float(wage))).alias(bspec.wage),
        F.coalesce(F.col("_years"), F.lit(int(years))).cast("int").alias(bspec.contract),
        F.coalesce(F.col("_resale"), F.lit(float(resale))).alias(bspec.resale))


def creation(bspec: BasketSpec) -> Column:
    return F.col(bspec.creation_a) + F.col(bspec.creation_b)


def composite_value_expr(bspec: BasketSpec) -> Column:
    """0.30 prog + 0.25 def + 0.25 (a + b) 5 + 0.20 (resale 4), as one
    codegen'd projection (evaluation order kept for bit-equal results)."""
    return (F.lit(0.30) * F.col(bspec.prog)
            + F.lit(0.25) * F.col(bspec.defence)
            + F.lit(0.25) * (F.col(bspec.creation_a) + F.col(bspec.creation_b)) * F.lit(5.0)
            + F.lit(0.20) * (F.col(bspec.resale) * F.lit(4.0)))


def with_composite_value(df: DataFrame, bspec: BasketSpec,
                         name: str = "composite_value") -> DataFrame:
    return df.withColumn(name, composite_value_expr(bspec))
