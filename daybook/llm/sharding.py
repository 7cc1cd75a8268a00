"""Sharding by fixed virtual slots.

A record's key and content hash into one of ``slots`` virtual slots, for good; so records of one key, however many, are
spread, and records without a key are dealt out by where they stand. The bytes of each slot are summed, and a map from
slot to shard is stored as a table with a version. The first version deals slots out evenly, before any bytes are known
(or, by ``first_map``, the largest slot first, always into the lightest shard); a later version is an edit of the one
before: slots move from the heaviest shard to the lightest until no move brings the sizes nearer. What is placed goes by
the latest version as it is read back. So the law is ``bytes``: sizes near equal.

A record's place in its shard is gapless from 0 without sorting any shard in one task: each virtual slot is numbered by
itself, and starts where the slots of the same shard before it end. All is done by DataFrame operations; what the
driver sees are the ``slots`` sums, a fixed number.

Defined cases: a null text counts as the empty one; rows that repeat are records of their own, told apart by size and
checksum only and otherwise in any order; an empty table gives no rows and
a map that spreads the slots evenly; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from daybook.llm.common import bare, shared_dir, stage, table

SLOTS = 4096
SHARDS = 40
OVERHEAD = 16


@dataclass(frozen=True)
class SlotMap:
    """shards[s] is the shard of virtual slot s."""

    version: int
    n_shards: int
    shards: tuple[int, ...]

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(self.version, self.n_shards, s, d) for s, d in enumerate(self.shards)]
        return spark.createDataFrame(rows, "version int, n_shards int, vslot int, shard int")

    def write(self, spark: SparkSession, path: str) -> None:
        """Adds this version to the stored map; versions already there stay."""
        self.table(spark).coalesce(1).write.mode("append").partitionBy("version").parquet(path)

    @staticmethod
    def read(spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
        stored = spark.read.parquet(path)
        version = version if version is not None else stored.agg(F.max("version")).first()[0]
        rows = stored.where(F.col("version") == version).orderBy("vslot").collect()
        return SlotMap(int(version), int(rows[0]["n_shards"]), tuple(int(r["shard"]) for r in rows))


def virtual_slot(key: Column, content: Column, slots: int = SLOTS) -> Column:
    """The slot of a record; one without a key gets what its place says, which is fixed once the record is staged."""
    alone = F.when(key.isNull(), F.monotonically_increasing_id())
    return F.pmod(F.xxhash64(key, content, alone), F.lit(slots)).cast("int")


def even_map(n_shards: int = SHARDS, slots: int = SLOTS) -> SlotMap:
    """Slots dealt out in turn: the version to begin with, where nothing is known of their bytes."""
    return SlotMap(1, n_shards, tuple(s % n_shards for s in range(slots)))


def slot_sums(records: DataFrame) -> DataFrame:
    """Bytes and rows of each virtual slot; records: vslot, size."""
    return records.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))


def first_map(sums: dict[int, int], n_shards: int = SHARDS, slots: int = SLOTS) -> SlotMap:
    """The largest slot first, into the shard with the fewest bytes, then slots, then the lowest number."""
    heap = [(0, 0, d) for d in range(n_shards)]
    placed = [0] * slots
    for s in sorted(range(slots), key=lambda s: (-sums.get(s, 0), s)):
        load, count, d = heapq.heappop(heap)
        placed[s] = d
        heapq.heappush(heap, (load + sums.get(s, 0), count + 1, d))
    return SlotMap(1, n_shards, tuple(placed))


def rebalanced(old: SlotMap, sums: dict[int, int], n_shards: int | None = None) -> SlotMap:
    """The next version: slots move from the heaviest shard to the lightest while that narrows the gap between them."""
    n = n_shards or old.n_shards
    placed = [d if d < n else -1 for d in old.shards]
    load, held = [0] * n, [[] for _ in range(n)]
    for s, d in enumerate(placed):
        if d >= 0:
            load[d] += sums.get(s, 0)
            held[d].append(s)
    for s in sorted((s for s, d in enumerate(placed) if d < 0), key=lambda s: -sums.get(s, 0)):
        d = min(range(n), key=lambda d: (load[d], len(held[d]), d))
        placed[s] = d
        load[d] += sums.get(s, 0)
        held[d].append(s)
    open_ = set(range(n))  # shards that may have a slot to give; one large slot may keep a shard above all others
    while open_:
        high, low = max(open_, key=lambda d: (load[d], -d)), min(range(n), key=lambda d: (load[d], len(held[d])))
        gap = load[high] - load[low]
        fit = [s for s in held[high] if 0 < sums.get(s, 0) < gap]
        if not fit:
            open_.discard(high)
            continue
        s = min(fit, key=lambda s: (abs(gap - 2 * sums[s]), s))
        held[high].remove(s)
        held[low].append(s)
        load[high] -= sums[s]
        load[low] += sums[s]
        placed[s] = low
    return SlotMap(old.version + 1, n, tuple(placed))


def place(records: DataFrame, sums: DataFrame, mapped: SlotMap, order: list[str]) -> DataFrame:
    """records (with vslot) and their shard and gapless place in it. Both broadcast tables have a row for each slot."""
    spark = records.sparkSession
    placed = mapped.table(spark).join(F.broadcast(sums), "vslot", "left")
    before = Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.select("vslot", "shard", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("vslot").orderBy(*order)
    numbered = records.withColumn("_rank", F.row_number().over(inside).cast("long") - 1)
    return numbered.join(F.broadcast(starts), "vslot").withColumn("slot", F.col("_start") + F.col("_rank")).drop("_start", "_rank")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = bare(F.col("text"))
    records = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
    )
    records = stage(records.withColumn("vslot", virtual_slot(F.col("doc_id"), F.col("text_crc32"))), "sharding-records")
    sums = stage(slot_sums(records).coalesce(1), "sharding-slots")
    path = f"{shared_dir(spark)}/sharding-map-{uuid.uuid4().hex[:12]}"
    even_map().write(spark, path)
    rebalanced(SlotMap.read(spark, path), {r["vslot"]: r["bytes"] for r in sums.collect()}).write(spark, path)
    mapped = SlotMap.read(spark, path)
    placed = place(records, sums, mapped, ["doc_id", "size", "text_crc32"])
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
        "vslot", F.lit(mapped.version).alias("map_version"),
    )
