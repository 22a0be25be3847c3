"""Rules as data, and the rows that break them set aside (C17).

A rule is a name and an SQL condition that a bad row fulfils.  ``apply_rules``
reads the table once: the same job evaluates every condition, writes good and
bad rows to two partitions of one table, the bad ones with the names of the
rules they break, and counts the rows of every rule on the way (an observed
metric, no second scan).  A condition that is null is not fulfilled."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from peerlens.session import shared_path


class Checked(NamedTuple):
    """``good`` and ``bad`` rows (``bad`` with ``rules``, the names in order),
    and how many rows were read, were bad, and broke each rule."""

    good: DataFrame
    bad: DataFrame
    rows: int
    rejected: int
    counts: dict[str, int]


def apply_rules(df: DataFrame, rules: DataFrame | list[tuple[str, str]],
                path: str | None = None) -> Checked:
    """Split ``df`` by ``rules``, (rule, condition) rows; names must differ."""
    pairs = rules if isinstance(rules, list) else [
        (r["rule"], r["condition"]) for r in rules.select("rule", "condition").collect()]
    names = [n for n, _ in pairs]
    if len(set(names)) < len(names):
        raise ValueError("two rules have the same name")
    flagged = df.select("*", F.array_compact(F.array(
        F.lit(None).cast("string"),
        *[F.when(F.expr(bad), F.lit(name)) for name, bad in pairs])).alias("rules"))
    seen = Observation()
    metrics = [F.count_if(F.array_contains("rules", name)).alias(f"rule {i}")
               for i, name in enumerate(names)]
    observed = flagged.observe(seen, F.count(F.lit(1)).alias("rows"),
                               F.count_if(F.size("rules") > 0).alias("rejected"), *metrics)
    path = path or shared_path(df.sparkSession, "checked")
    observed.withColumn("is_good", F.size("rules") == 0).write.partitionBy("is_good").parquet(path)
    out = df.sparkSession.read.schema(
        flagged.withColumn("is_good", F.lit(True)).schema).parquet(path)
    got = seen.get
    return Checked(out.where("is_good").select(*df.columns),
                   out.where("NOT is_good").select(*df.columns, "rules"),
                   int(got["rows"]), int(got["rejected"]),
                   {name: int(got[f"rule {i}"]) for i, name in enumerate(names)})
