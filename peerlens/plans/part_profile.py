"""The part profile: the driver's TPC-H-style tables seen as entity profiles.

One row per part: ``part`` joined to its line statistics, aggregated from
integers (cents, percentage points) and divided once, so every engine
gets bit-identical metrics.  Column roles:

    key=p_partkey  name=p_label  position=p_brand  league=p_line (first
    word of p_name)  role=p_kind (second word)  team=p_type  age=p_size
    minutes=n_lines

The cohort dimension is a literal on the brand; two brands are left
unmapped so the default-cohort path is exercised on real data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peerlens.dims import Dimensions
from peerlens.schemas import BasketSpec, ProfileSpec
from peerlens.session import parquet

PART_SPEC = ProfileSpec(key="p_partkey", name="p_label", position="p_brand", league="p_line",
                        role="p_kind", team="p_type", age="p_size", minutes="n_lines")

PART_BASKET = BasketSpec(fee="fee", wage="wage", prog="qty_avg", defence="n_lines",
                         creation_a="ret_share", creation_b="open_share", resale="resale",
                         contract="contract_years")

PART_METRICS = ["n_lines", "qty_avg", "qty_max", "price_avg_k", "disc_avg", "tax_avg",
                "ret_share", "open_share"]

# ---------------------------------------------------------------------------
# Fixed values of the part configuration (our own test dimension).
# ---------------------------------------------------------------------------
PART_COHORTS = ("Bulk", "Premium", "Discount", "Steady", "Returns", "Mixed")
PART_MAPPED_BRANDS = 23          # Brand#1..#23 mapped; Brand#24, #25 are not
PART_DEFAULT_COHORT = "Steady"
PART_ROLE_METRICS = (
    ("Bulk", (("qty_avg", 1.6, "Avg Qty"), ("qty_max", 1.2, "Max Qty"),
              ("n_lines", 1.4, "Lines"), ("price_avg_k", 1.0, "Avg Price k"),
              ("disc_avg", 1.2, "Avg Disc"), ("open_share", 0.8, "Open %"))),
    ("Premium", (("price_avg_k", 1.8, "Avg Price k"), ("tax_avg", 1.2, "Avg Tax"),
                 ("disc_avg", 1.4, "Avg Disc"), ("qty_avg", 1.0, "Avg Qty"),
                 ("ret_share", 1.1, "Returned %"), ("n_lines", 1.0, "Lines"),
                 ("open_share", 0.9, "Open %"), ("qty_max", 1.3, "Max Qty"))),
    ("Discount", (("disc_avg", 2.0, "Avg Disc"), ("price_avg_k", 1.5, "Avg Price k"),
                  ("qty_avg", 1.2, "Avg Qty"), ("ret_share", 1.4, "Returned %"),
                  ("tax_avg", 1.0, "Avg Tax"), ("n_lines", 1.1, "Lines"),
                  ("open_share", 1.2, "Open %"))),
    ("Steady", (("n_lines", 1.6, "Lines"), ("qty_avg", 1.4, "Avg Qty"),
                ("open_share", 1.4, "Open %"), ("ret_share", 1.4, "Returned %"),
                ("price_avg_k", 1.0, "Avg Price k"), ("disc_avg", 1.6, "Avg Disc"),
                ("tax_avg", 1.1, "Avg Tax"), ("qty_max", 1.4, "Max Qty"))),
    ("Returns", (("ret_share", 2.0, "Returned %"), ("open_share", 1.6, "Open %"),
                 ("disc_avg", 1.4, "Avg Disc"), ("qty_avg", 1.2, "Avg Qty"),
                 ("n_lines", 1.2, "Lines"), ("tax_avg", 1.0, "Avg Tax"))),
    ("Mixed", (("tax_avg", 1.8, "Avg Tax"), ("price_avg_k", 1.6, "Avg Price k"),
               ("qty_max", 1.5, "Max Qty"), ("open_share", 1.4, "Open %"),
               ("disc_avg", 1.4, "Avg Disc"), ("ret_share", 1.2, "Returned %"),
               ("qty_avg", 1.4, "Avg Qty"), ("n_lines", 1.1, "Lines"))),
)
PART_ROLE_FAMILY = (
    ("ring", "fastening"), ("bolt", "fastening"),
    ("rod", "drive"), ("gear", "drive"),
    ("anvil", "heavy"), ("plate", "heavy"),
)
PART_TYPE_SECONDARY = (("PROMO", "drive"), ("LARGE", "heavy"), ("SMALL", "fastening"))
PART_UNITS = (("U-A", 1, 6), ("U-B", 7, 12), ("U-C", 13, 18), ("U-D", 19, 25))
# Listing window of market_enrich: parts with a line shipped on/after this day
# get a market profile; the others take the market defaults.
MARKET_SINCE = "2001-09-01"
MARKET_DEFAULT = (30.0, 60.0, 3, 1.10)

PARTS = Dimensions(
    position_cohort=tuple((f"Brand#{n}", PART_COHORTS[(n - 1) % len(PART_COHORTS)])
                          for n in range(1, PART_MAPPED_BRANDS + 1)),
    role_metrics=PART_ROLE_METRICS,
    default_cohort=PART_DEFAULT_COHORT,
    role_family=PART_ROLE_FAMILY,
    position_unit=tuple((u, tuple(f"Brand#{n}" for n in range(lo, hi + 1)))
                        for u, lo, hi in PART_UNITS),
)


def line_stats(lineitem: DataFrame) -> DataFrame:
    return lineitem.groupBy("l_partkey").agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.sum(F.col("l_quantity").cast("bigint")).alias("qty_sum"),
        F.max("l_quantity").alias("qty_max"),
        F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint")).alias("price_cents"),
        F.sum(F.round(F.col("l_discount") * 100).cast("bigint")).alias("disc_pts"),
        F.sum(F.round(F.col("l_tax") * 100).cast("bigint")).alias("tax_pts"),
        F.count_if(F.col("l_returnflag") == "R").alias("n_ret"),
        F.count_if(F.col("l_linestatus") == "O").alias("n_open"))


def build_part_profile(part: DataFrame, lineitem: DataFrame) -> DataFrame:
    """S1 + aggregation: one profile row per part (parts without lines get
    null metrics and are left out of vectors)."""
    st = line_stats(lineitem)
    n = F.col("n_lines")
    nz = n > 0

    def per_line(num, scale=1.0):
        return F.when(nz, num / (n * F.lit(scale)))

    return (part.join(st, part["p_partkey"] == st["l_partkey"], "left")
            .select(
                "p_partkey",
                F.concat_ws("/", "p_brand", "p_name", F.col("p_partkey").cast("string"))
                 .alias("p_label"),
                "p_brand",
                F.split_part("p_name", F.lit(" "), F.lit(1)).alias("p_line"),
                F.split_part("p_name", F.lit(" "), F.lit(2)).alias("p_kind"),
                "p_type", "p_size", "p_retailprice",
                F.coalesce(n, F.lit(0)).cast("int").alias("n_lines"),
                per_line(F.col("qty_sum").cast("double")).alias("qty_avg"),
                F.col("qty_max").alias("qty_max"),
                per_line(F.col("price_cents").cast("double"), 100000.0).alias("price_avg_k"),
                per_line(F.col("disc_pts").cast("double"), 100.0).alias("disc_avg"),
                per_line(F.col("tax_pts").cast("double"), 100.0).alias("tax_avg"),
                per_line(F.col("n_ret").cast("double")).alias("ret_share"),
                per_line(F.col("n_open").cast("double")).alias("open_share")))


def part_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_part_profile(parquet(spark, sf_dir, "part"), parquet(spark, sf_dir, "lineitem"))


def part_market(lineitem: DataFrame, since: str | None = None) -> DataFrame:
    """Market dimension from all lines, or only from those since a day (sparse)."""
    recent = lineitem
    if since is not None:
        recent = lineitem.where(F.col("l_shipdate") >= F.lit(since).cast("timestamp_ntz"))
    n = F.count(F.lit(1))
    return recent.groupBy(F.col("l_partkey").alias("p_partkey")).agg(
        (F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint")).cast("double")
         / (n * F.lit(100000.0))).alias("fee"),
        (F.sum(F.col("l_quantity").cast("bigint") * F.lit(5)).cast("double") / n).alias("wage"),
        n.cast("int").alias("contract_years"),
        (F.lit(1.0) + F.sum(F.round(F.col("l_discount") * 100).cast("bigint")).cast("double")
         / (n * F.lit(50.0))).alias("resale"))


def part_secondary(part: DataFrame) -> DataFrame:
    """Secondary tag table (key, family) derived from p_type (J4 source)."""
    m = F.create_map(*[e for t, f in PART_TYPE_SECONDARY for e in (F.lit(t), F.lit(f))])
    return (part.select(F.col("p_partkey").alias("key"), m[F.col("p_type")].alias("family"))
                .where(F.col("family").isNotNull()))
