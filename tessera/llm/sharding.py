"""Sharding by fixed virtual slots.

A record's slot is a hash of its id and text modulo SLOTS, for ever. What changes is the
slot-to-shard map, a small versioned table: version 1 deals the slots in turn,
and every later version is an edit of the one before that moves (or swaps) as
few slots as even bytes need. Only the bytes of each slot, SLOTS numbers
whatever the input's size, reach the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import unused_name

SLOTS = 8192
MAP_SCHEMA = "version int, slot int, shard int"


@dataclass(frozen=True)
class SlotMap:
    """Which shard holds each slot, and the version of that choice."""

    version: int
    shards: int
    owner: tuple[int, ...]

    @staticmethod
    def first(shards: int, slots: int = SLOTS) -> SlotMap:
        return SlotMap(1, shards, tuple(i % shards for i in range(slots)))

    def rebalanced(self, size: np.ndarray, shards: int | None = None) -> SlotMap:
        """The next version: slots move from the fullest to the emptiest shard, or swap places with smaller ones, while that evens out bytes."""
        shards = shards or self.shards
        owner, size = np.array(self.owner), np.asarray(size, np.int64)
        for gone in np.flatnonzero(owner >= shards):
            owner[gone] = gone % shards
        load = np.bincount(owner, size, shards).astype(np.int64)
        for _ in range(4 * len(owner)):
            hi, lo = int(load.argmax()), int(load.argmin())
            gap = int(load[hi] - load[lo])
            give, take = np.flatnonzero((owner == hi) & (size > 0)), np.flatnonzero(owner == lo)
            if gap < 2 or not len(give):
                break
            # What moves over, net, should be half of the gap.
            back = np.r_[0, np.sort(size[take])]
            want = size[give] - gap / 2
            at = np.clip(np.searchsorted(back, want), 1, len(back) - 1) if len(back) > 1 else np.zeros(len(give), np.int64)
            near = np.where(np.abs(back[at] - want) <= np.abs(back[np.maximum(at - 1, 0)] - want), at, np.maximum(at - 1, 0))
            net = size[give] - back[near]
            best = int(np.abs(net - gap / 2).argmin())
            if not 0 < net[best] < gap:
                break
            owner[give[best]] = lo
            if near[best]:
                owner[take[np.argsort(size[take], kind="stable")[near[best] - 1]]] = hi
            load[hi] -= net[best]
            load[lo] += net[best]
        return SlotMap(self.version + 1, shards, tuple(int(x) for x in owner))

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(self.version, i, s) for i, s in enumerate(self.owner)], MAP_SCHEMA)

    def save(self, spark: SparkSession, path: str) -> None:
        """Adds this version to the table at path; versions are never overwritten."""
        self.rows(spark).coalesce(1).write.mode("append").partitionBy("version").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
        """That version, or the newest."""
        kept = spark.read.schema(MAP_SCHEMA).parquet(path)
        version = version or kept.agg(F.max("version")).first()[0]
        found = sorted((r["slot"], r["shard"]) for r in kept.filter(F.col("version") == version).collect())
        return SlotMap(version, 1 + max(s for _, s in found), tuple(s for _, s in found))


def slot_of(mark, slots: int = SLOTS):
    """The slot of a row with that mark, a hash of id and text: rows that share one of them don't share a slot."""
    return F.pmod(mark, F.lit(slots)).cast("int")


def mark_of(id_col: str = "doc_id", text_col: str = "text"):
    return F.xxhash64(F.col(id_col), F.col(text_col))


def slot_bytes(records: DataFrame, slots: int = SLOTS) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and rows of each slot, of records with mark and size."""
    size, rows = np.zeros(slots, np.int64), np.zeros(slots, np.int64)
    sums = records.select(slot_of(F.col("mark"), slots).alias("s"), F.col("size").alias("z")).groupBy("s").agg(F.sum("z").alias("z"), F.count("*").alias("n"))
    for r in sums.collect():  # at most `slots` rows
        size[r["s"]], rows[r["s"]] = r["z"], r["n"]
    return size, rows


def record_size(text_col: str = "text"):
    """UTF-8 bytes of the text (null: none) and 8 for the id."""
    return (F.coalesce(F.octet_length(text_col), F.lit(0)) + 8).cast("long")


def shard(docs: DataFrame, shards: int = 24, current: SlotMap | None = None, id_col: str = "doc_id", text_col: str = "text", size=None, mark=None) -> tuple[DataFrame, SlotMap]:
    """docs with vslot, shard, place (gapless from 0 in the shard) and map_version, and the map used.

    The map is an edit of `current` (by default of version 1) for the bytes that
    the slots hold now. Rows keep all their columns; added names that docs has
    already get a trailing underscore. Null texts count no bytes; rows equal in
    id and text share a slot, others with null or equal ids don't; an empty table
    keeps version 1's dealing. Frames that don't carry texts give columns for
    their size and mark (of mark_of()), so that no text has to move.
    """
    spark, current = docs.sparkSession, current or SlotMap.first(shards)
    size = record_size(text_col) if size is None else size
    mark = mark_of(id_col, text_col) if mark is None else mark
    held, rows = slot_bytes(docs.select(size.alias("size"), mark.alias("mark")), len(current.owner))
    chosen = current.rebalanced(held, shards)
    before, at = [0] * shards, []
    for i, s in enumerate(chosen.owner):
        at.append((i, s, before[s]))
        before[s] += int(rows[i])
    # Of fixed size: one row for each slot.
    owners = F.broadcast(spark.createDataFrame(at, "vslot_key int, shard_to int, rows_before long"))
    names = [unused_name(docs, n) for n in ("vslot", "shard", "place", "map_version")]
    order = Window.partitionBy("vslot_key").orderBy(id_col, "mark_key")
    placed = docs.withColumn("mark_key", mark).withColumn("vslot_key", slot_of(F.col("mark_key"), len(current.owner))).join(owners, "vslot_key")
    placed = placed.withColumn("rows_before", F.col("rows_before") + F.row_number().over(order) - 1)
    added = ("vslot_key", "shard_to", "rows_before")
    return placed.select(*docs.columns, *[F.col(c).alias(n) for c, n in zip(added, names, strict=False)], F.lit(chosen.version).alias(names[3])), chosen


def shard_by_stored_map(docs: DataFrame, path: str, shards: int = 24, **more) -> DataFrame:
    """shard() by an edit of the newest map stored at path; the edit is stored as the next version. Where there is none yet, version 1 is stored first."""
    spark = docs.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        SlotMap.first(shards).save(spark, path)
    placed, chosen = shard(docs, shards, SlotMap.load(spark, path), **more)
    chosen.save(spark, path)
    return placed
