"""Sharding by fixed virtual slots.

Records are hashed into ``SLOTS`` virtual slots, a number that never changes
while shards come and go; size and checksum count too, so the texts of an id that
repeats, or is null, do not meet in one slot.  One aggregation counts rows and bytes per slot; a
versioned map (version, slot, shard) says which shard owns a slot.  Placing a
record needs only its slot and the map.  ``rebalance`` edits a map by moving
the fewest slots it finds until shard sizes are near equal; ``grow`` adds a
shard that takes slots from the others and moves none between them.

The law of the placement is ``bytes``: shard sizes in bytes are near equal
(the map is edited by the bytes of the slots, so it depends on the data; a
third shard count decides nothing by itself).

Cases: a null text has size 1 and the checksum of no bytes; a null id is
hashed as a null; repeated rows are counted first and get positions of their
own, ``COPIES`` of them at most in a slot together; an empty table keeps the first map and gives no rows; other columns of
the input are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from peerlens.session import shared_path, stored

SLOTS = 4096
COPIES = 1024           # equal rows in a piece: each piece has a slot of its own
TOLERANCE = 1e-4        # stop once the largest and smallest shard differ by this share


def slot_of(columns: list[str], slots: int = SLOTS) -> F.Column:
    """The virtual slot of a record: a hash of what tells it from others."""
    return F.pmod(F.xxhash64(*columns, F.lit("slot")), F.lit(slots)).cast("int")


def first_map(shards: int, slots: int = SLOTS) -> np.ndarray:
    """Version 0: slots dealt round."""
    return np.arange(slots) % shards


def rebalance(owner: np.ndarray, size: np.ndarray, shards: int,
              tolerance: float = TOLERANCE) -> np.ndarray:
    """Edit a map until shard sizes are near equal.

    Each step takes the largest and the smallest shard and moves the slot, or
    swaps the pair of slots, that comes closest to halving their difference."""
    owner, size = owner.copy(), size.astype(np.int64)
    load = np.bincount(owner, weights=size, minlength=shards).astype(np.int64)
    goal = max(1, int(tolerance * load.sum() / max(1, shards)))
    for _ in range(8 * len(owner)):
        big, small = int(load.argmax()), int(load.argmin())
        gap = load[big] - load[small]
        if gap <= goal:
            break
        ours, theirs = np.flatnonzero(owner == big), np.flatnonzero(owner == small)
        theirs = theirs[np.argsort(size[theirs], kind="stable")]
        back = np.concatenate([[0], size[theirs]])          # 0: a move without return
        want = size[ours] - gap / 2                         # best size to get back
        at = np.searchsorted(back, want)
        pick = np.stack([np.clip(at - 1, 0, len(back) - 1), np.clip(at, 0, len(back) - 1)])
        net = size[ours][None, :] - back[pick]
        miss = np.where((net > 0) & (net < gap), np.abs(net - gap / 2), np.inf)
        side, k = np.unravel_index(int(miss.argmin()), miss.shape)
        if not np.isfinite(miss[side, k]):
            break
        owner[ours[k]] = small
        if pick[side, k] > 0:
            owner[theirs[pick[side, k] - 1]] = big
        load[big] -= net[side, k]
        load[small] += net[side, k]
    return owner


def grow(owner: np.ndarray, size: np.ndarray, shards: int) -> np.ndarray:
    """Add shard number ``shards``: it takes slots, largest shard first, until
    it holds its share; no slot moves between the old shards."""
    owner, size = owner.copy(), size.astype(np.int64)
    load = np.bincount(owner, weights=size, minlength=shards + 1).astype(np.int64)
    share = load.sum() / (shards + 1)
    for _ in range(len(owner)):
        room = share - load[shards]
        big = int(load[:shards].argmax())
        ours = np.flatnonzero((owner == big) & (size > 0) & (size <= room))
        if not len(ours):
            break
        k = ours[np.abs(size[ours] - min(room, max(1, load[big] - share))).argmin()]
        owner[k] = shards
        load[big] -= size[k]
        load[shards] += size[k]
    return owner


def slot_sizes(df: DataFrame, slots: int = SLOTS) -> np.ndarray:
    """Bytes per virtual slot: an aggregate of at most ``slots`` rows."""
    rows = df.groupBy("virtual_slot").agg(F.sum("bytes").alias("b")).collect()
    size = np.zeros(slots, np.int64)
    for r in rows:
        size[r[0]] = r[1]
    return size


class SlotMap:
    """The stored map: a Parquet table (version, virtual_slot, shard) of
    ``slots`` rows per version.  Every edit adds a version."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def write(self, version: int, owner: np.ndarray) -> None:
        table = pd.DataFrame({"version": np.int32(version),
                              "virtual_slot": np.arange(len(owner), dtype=np.int32),
                              "shard": owner.astype(np.int32)})
        (self.spark.createDataFrame(table).coalesce(1)
         .write.mode("append").partitionBy("version").parquet(self.path))

    def read(self, version: int) -> DataFrame:
        return (self.spark.read.parquet(self.path).where(F.col("version") == version)
                .select(F.col("virtual_slot").cast("int").alias("virtual_slot"),
                        F.col("shard").cast("int").alias("shard")))


def shard(df: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text",
          slots: int = SLOTS, map_path: str | None = None) -> DataFrame:
    """Place every record: id, size, text_crc32, shard, slot (the record's
    position in its shard, gapless from 0), virtual_slot and map_version.

    Positions need no task that holds a shard: a record's position is the
    rows of earlier virtual slots of the shard plus its rank in its own."""
    spark = df.sparkSession
    raw = F.coalesce(F.encode(F.col(text_col), "UTF-8"), F.lit(b""))
    records = df.select(F.col(id_col), (F.octet_length(raw) + 1).cast("long").alias("size"),
                        F.crc32(raw).alias("text_crc32"))
    # repeated rows collapse to pieces with a count, so that no slot is hot
    keys = [id_col, "size", "text_crc32"]
    piece = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / F.lit(COPIES))))
    held = F.least(F.lit(COPIES).cast("long"), F.col("n") - F.col("piece") * F.lit(COPIES))
    counted = stored(records.groupBy(*keys).agg(F.count("*").alias("n"))
                     .withColumn("piece", piece).withColumn("n", held)
                     .withColumn("virtual_slot", slot_of([*keys, "piece"], slots))
                     .withColumn("bytes", F.col("size") * F.col("n")), "sharding-records")

    size = slot_sizes(counted, slots)
    maps = SlotMap(spark, map_path or shared_path(spark, "slot-map"))
    owner = first_map(shards, slots)
    maps.write(0, owner)
    maps.write(1, rebalance(owner, size, shards))
    owners = maps.read(1)

    per_slot = (counted.groupBy("virtual_slot").agg(F.sum("n").alias("rows"))
                .join(F.broadcast(owners), "virtual_slot"))        # at most `slots` rows
    earlier = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(
        Window.unboundedPreceding, -1)
    starts = per_slot.select("virtual_slot", "shard",
                             F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("start"))
    in_slot = Window.partitionBy("virtual_slot").orderBy(F.col(id_col), "size", "text_crc32",
                                                                    "piece")
    before = F.coalesce(F.sum("n").over(in_slot.rowsBetween(Window.unboundedPreceding, -1)),
                        F.lit(0))
    placed = counted.withColumn("before", before).join(F.broadcast(starts), "virtual_slot")
    copies = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))
    return placed.withColumn("copy", copies).select(
        id_col, "size", "text_crc32", "shard",
        (F.col("start") + F.col("before") + F.col("copy")).alias("slot"),
        "virtual_slot", F.lit(1).alias("map_version"))
