"""Sharding by fixed virtual slots and a versioned slot-to-shard map.

Records hash into a few thousand slots for good. The map says which shard holds a
slot; it is made from the slots' bytes, kept in versions, and edited when loads
drift or a shard is added, so only the slots that an edit names move.
"""

from __future__ import annotations

import heapq
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from locusflow.llm.common import cut, documents, exists, shared_dir

SLOTS, SHARDS = 4096, 8


def virtual_slot(doc_id: Column, text: Column, slots: int = SLOTS) -> Column:
    """The slot of a record: by its id and text, so an id with very many texts fills no slot."""
    return F.pmod(F.xxhash64(doc_id.cast("bigint"), text), F.lit(slots)).cast("int")


def size_bytes(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("bigint")


@dataclass(frozen=True)
class SlotMap:
    """One version of the map: ``shard_of[slot]``."""

    version: int
    shards: int
    shard_of: tuple[int, ...]

    @classmethod
    def build(cls, loads: list[int], shards: int) -> SlotMap:
        """Version 1: heaviest slot first, each to the lightest shard; ties by number."""
        heap, out = [(0, s) for s in range(shards)], [0] * len(loads)
        for slot in sorted(range(len(loads)), key=lambda i: (-loads[i], i)):
            load, shard = heapq.heappop(heap)
            out[slot] = shard
            heapq.heappush(heap, (load + loads[slot], shard))
        return cls(1, shards, tuple(out))

    def shard_loads(self, loads: list[int]) -> list[int]:
        out = [0] * self.shards
        for slot, shard in enumerate(self.shard_of):
            out[shard] += loads[slot]
        return out

    def rebalance(self, loads: list[int], tolerance: float = 0.01) -> SlotMap:
        """The next version: slots move from the heaviest to the lightest shard while that narrows the gap.

        Each move takes the slot nearest to half the gap; it ends when the spread
        is within ``tolerance`` of the mean or no move helps.
        """
        out, sums = list(self.shard_of), self.shard_loads(loads)
        while True:
            hi, lo = max(range(self.shards), key=lambda s: (sums[s], -s)), min(range(self.shards), key=lambda s: (sums[s], s))
            gap = sums[hi] - sums[lo]
            own = [i for i, s in enumerate(out) if s == hi and 0 < loads[i] < gap]
            if gap <= tolerance * sum(sums) / self.shards or not own:
                return SlotMap(self.version + 1, self.shards, tuple(out))
            slot = min(own, key=lambda i: (abs(2 * loads[i] - gap), i))
            out[slot], sums[hi], sums[lo] = lo, sums[hi] - loads[slot], sums[lo] + loads[slot]

    def grow(self, loads: list[int]) -> SlotMap:
        """The next version with one more shard, which takes slots up to its share; no other slot moves."""
        out, sums, new = list(self.shard_of), [*self.shard_loads(loads), 0], self.shards
        share = sum(sums) / (self.shards + 1)
        for slot in sorted(range(len(out)), key=lambda i: (-loads[i], i)):
            if sums[out[slot]] - loads[slot] >= share and sums[new] + loads[slot] <= share:
                sums[out[slot]] -= loads[slot]
                sums[new] += loads[slot]
                out[slot] = new
        return SlotMap(self.version + 1, self.shards + 1, tuple(out))

    def save(self, spark: SparkSession, path: str) -> None:
        """Append this version to the map table; versions stay readable."""
        rows = [(self.version, self.shards, i, s) for i, s in enumerate(self.shard_of)]
        spark.createDataFrame(rows, "version int, shards int, vslot int, shard int").coalesce(1).write.mode("append").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
        """A version of the map table, the last by default."""
        table = spark.read.parquet(path)
        v = version if version is not None else table.agg(F.max("version")).first()[0]
        rows = sorted((r.vslot, r.shard, r.shards) for r in table.where(F.col("version") == v).collect())
        return cls(v, rows[0][2], tuple(s for _, s, _ in rows))


def slot_loads(rows: DataFrame, slots: int = SLOTS) -> tuple[list[int], list[int]]:
    """Bytes and rows per slot of ``rows`` (vslot, size): two lists of ``slots`` numbers, whatever the input."""
    size, count = [0] * slots, [0] * slots
    for r in rows.groupBy("vslot").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect():
        size[r.vslot], count[r.vslot] = r.b, r.n
    return size, count


def current_map(spark: SparkSession, path: str, loads: list[int], shards: int) -> SlotMap:
    """The map stored at ``path``, edited for ``loads`` and stored again if that moves slots; version 1 where there is none.

    A stored map keeps its own number of shards, as it may have grown; ``shards`` is that of a
    new one. Its slots must be those that ``loads`` are of, or rows would have no shard.
    """
    if not exists(spark, path):
        SlotMap.build(loads, shards).save(spark, path)
    stored = SlotMap.load(spark, path)
    if len(stored.shard_of) != len(loads):
        raise ValueError(f"the map at {path} has {len(stored.shard_of)} slots, not {len(loads)}")
    edited = stored.rebalance(loads)
    if edited.shard_of != stored.shard_of:
        edited.save(spark, path)
    return SlotMap.load(spark, path)


def new_map_path(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/slot-maps/{uuid.uuid4().hex}"


def assign_shards(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, map_path: str | None = None) -> DataFrame:
    """``docs`` with ``shard``, in the place of any such column.

    One pass for the slots' bytes, then a join with the map, without shuffling texts.
    The map is read from ``map_path``, edited if loads have drifted, and stored there;
    without a path a new one is made in the shared folder.
    """
    spark = docs.sparkSession
    slotted = docs.drop("shard").withColumn("__vslot", virtual_slot(F.col("doc_id"), F.col("text"), slots))
    loads, _ = slot_loads(slotted.select(F.col("__vslot").alias("vslot"), size_bytes(F.col("text")).alias("size")), slots)
    slot_map = current_map(spark, map_path or new_map_path(spark), loads, shards)
    table = spark.createDataFrame(list(enumerate(slot_map.shard_of)), "__vslot int, shard int")
    return slotted.join(F.broadcast(table), "__vslot").drop("__vslot")  # the map has `slots` rows


def shard_documents(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, map_path: str | None = None) -> DataFrame:
    """Per document: size, text_crc32, law, shard, slot (its place in the shard), grown_shard, vslot, map_version.

    The law is ``bytes``. Places count up within a slot by doc_id, and slots of a
    shard follow one another, so no shard is sorted as a whole. Null texts have
    size 1 and the empty text's CRC; rows without doc_id go by their text; equal
    rows share a slot and have places of their own; an empty table gives no rows. The
    map is kept at ``map_path`` as ``assign_shards`` keeps it.
    """
    text = F.col("text")
    rows = cut(docs.select("doc_id", size_bytes(text).alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"), virtual_slot(F.col("doc_id"), text, slots).alias("vslot")))
    loads, counts = slot_loads(rows, slots)
    slot_map = current_map(docs.sparkSession, map_path or new_map_path(docs.sparkSession), loads, shards)
    used, first = [0] * slot_map.shards, []
    for slot, shard in enumerate(slot_map.shard_of):
        first.append((slot, shard, used[shard]))
        used[shard] += counts[slot]
    table = docs.sparkSession.createDataFrame(first, "vslot int, shard int, first bigint")
    place = F.row_number().over(Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size")) - 1
    out = rows.withColumn("place", place).join(F.broadcast(table), "vslot")  # the map has `slots` rows
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first") + F.col("place")).cast("bigint").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "vslot", F.lit(slot_map.version).alias("map_version"),
    )


def op4_shard_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(documents(spark, sf_dir))
