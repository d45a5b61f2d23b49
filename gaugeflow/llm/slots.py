"""Sharding through fixed virtual slots.

A record is hashed into one of ``SLOTS`` slots, whose number never changes. Bytes and rows are summed
by slot, and a small table says which shard each slot is in. That table has versions: balancing or
growing writes a new one in which few slots have moved, so a record moves only with its slot, and
readers of an older version still find it where it was.

Only the table and the sums by slot (``SLOTS`` rows, whatever the input) reach the driver or are
broadcast. The hash takes doc_id, size and checksum of the text, so copies of a text and rows of one
doc_id are spread. Rows equal in all three share a slot unless they outnumber an average slot: then
they are dealt to slots by their place in the input. There are fewer than ``SLOTS`` kinds of such rows.

A null text has no bytes and the checksum 0, a null doc_id hashes like an empty one; equal rows each
get a place; an empty table gives an empty one; further columns are kept by ``slotted`` and ``sharded``
(columns named virtual_slot or shard are replaced) and ignored by ``placed``.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugeflow.llm.common import scratch_path, stash

#: A power of 16: a slot is the first digits of a record's MD5.
SLOTS = 4096
SHARDS = 24
#: Bytes that a record takes beside its text.
RECORD_BYTES = 8
#: Rows of one kind that are never too many for a slot.
FEW_ROWS = 1000
_DIGITS = 3

Sums = dict[int, tuple[int, int]]


def size_of(text: str = "text") -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + RECORD_BYTES).cast("long")


def checksum_of(text: str = "text") -> Column:
    return F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary"))


def _slot(lane: Column | None = None) -> Column:
    parts = [F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("__crc").cast("string"), F.col("__size").cast("string")]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts, *([] if lane is None else [lane.cast("string")])).cast("binary")), 1, _DIGITS), 16, 10).cast("long")


def _crowded(rows: DataFrame) -> DataFrame | None:
    """The kinds of rows (doc_id, __crc, __size) that outnumber an average slot, if any: fewer than SLOTS. Looked for in crowded slots only."""
    counts = {r["slot"]: r["n"] for r in rows.groupBy(_slot().alias("slot")).agg(F.count("*").alias("n")).collect()}
    mean = sum(counts.values()) / SLOTS
    least = max(FEW_ROWS, mean)
    full = [slot for slot, n in counts.items() if n > least + mean]
    if not full:
        return None
    kinds = rows.where(_slot().isin(full)).groupBy("doc_id", "__crc", "__size").agg(F.count("*").alias("n")).where(F.col("n") > least)
    return kinds.select(F.col("doc_id").alias("__id"), F.col("__crc").alias("__c"), F.col("__size").alias("__s"), F.lit(True).alias("__many"))


def slotted(docs: DataFrame) -> DataFrame:
    """``docs`` with the slot of each row (virtual_slot), its size and its checksum (__size, __crc)."""
    rows = docs.withColumns({"__size": size_of(), "__crc": checksum_of()})
    kinds = _crowded(rows.select("doc_id", "__crc", "__size"))
    if kinds is None:
        return rows.withColumn("virtual_slot", _slot())
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__crc") == F.col("__c")) & (F.col("__size") == F.col("__s"))
    lane = F.when(F.col("__many"), F.col("__place") % SLOTS).otherwise(F.lit(0))
    # without a lane the hash is that of every other row; concat_ws leaves nulls out
    rows = rows.withColumn("__place", F.monotonically_increasing_id()).join(F.broadcast(kinds), same, "left")
    return rows.withColumn("virtual_slot", _slot(F.when(F.col("__many"), lane))).drop("__place", "__id", "__c", "__s", "__many")


def sums_by_slot(rows: DataFrame) -> Sums:
    """(bytes, rows) of each slot that has rows: at most SLOTS rows come to the driver."""
    found = rows.groupBy("virtual_slot").agg(F.sum("__size").alias("bytes"), F.count("*").alias("n")).collect()
    return {r["virtual_slot"]: (r["bytes"], r["n"]) for r in found}


def first_map(sums: Sums, shards: int = SHARDS) -> list[int]:
    """The shard of each slot: largest slots first, each to the shard with fewest bytes (ties: smallest number); empty slots in turn."""
    out = [-1] * SLOTS
    loads = [(0, shard) for shard in range(shards)]
    for slot in sorted(sums, key=lambda s: (-sums[s][0], s)):
        load, shard = loads[0]
        out[slot] = shard
        heapq.heapreplace(loads, (load + sums[slot][0], shard))
    empty = [slot for slot in range(SLOTS) if out[slot] < 0]
    for k, slot in enumerate(empty):
        out[slot] = k % shards
    return out


def _loads(at: list[int], sums: Sums, shards: int) -> list[int]:
    loads = [0] * shards
    for slot, (size, _) in sums.items():
        loads[at[slot]] += size
    return loads


def rebalanced(at: list[int], sums: Sums, shards: int, tolerance: float = 0.02) -> list[int]:
    """An edited map: while a shard is over the mean by more than ``tolerance``, the fullest shard gives a slot to the emptiest.

    Of its slots it gives the largest that doesn't take the emptiest beyond the mean, or else the smallest that
    leaves both below what the fullest had. It ends where no slot helps. Shards that ``at`` doesn't name yet start empty.
    """
    out, loads = list(at), _loads(at, sums, shards)
    mean = sum(loads) / shards
    held: list[set[int]] = [set() for _ in range(shards)]
    for slot in sums:
        held[out[slot]].add(slot)
    while max(loads) > mean * (1 + tolerance):
        full, empty = loads.index(max(loads)), loads.index(min(loads))
        sizes = sorted((sums[slot][0], slot) for slot in held[full] if sums[slot][0])
        fits = [x for x in sizes if loads[empty] + x[0] <= mean] or [x for x in sizes[:1] if loads[empty] + x[0] < loads[full]]
        if not fits:
            break
        size, slot = fits[-1]
        held[full].remove(slot)
        held[empty].add(slot)
        out[slot], loads[full], loads[empty] = empty, loads[full] - size, loads[empty] + size
    return out


def grown(at: list[int], sums: Sums, shards: int) -> list[int]:
    """An edited map with shard number ``shards`` more: the fullest shards in turn give it slots until it has its mean; nothing else moves."""
    out, loads = list(at), [*_loads(at, sums, shards), 0]
    mean = sum(loads) / (shards + 1)
    held: list[list[tuple[int, int]]] = [[] for _ in range(shards)]
    for slot, (size, _) in sums.items():
        held[out[slot]].append((size, slot))
    for slots in held:
        slots.sort()
    while any(held):
        full = max((s for s in range(shards) if held[s]), key=lambda s: loads[s])
        size, slot = held[full].pop()
        if size and loads[shards] + size <= mean:
            out[slot], loads[full], loads[shards] = shards, loads[full] - size, loads[shards] + size
    for k, slot in enumerate(s for s in range(SLOTS) if s not in sums):
        if k % (shards + 1) == shards:
            out[slot] = shards
    return out


def write_map(spark: SparkSession, path: str, at: Iterable[int], version: int) -> None:
    """Stores a version of the map (slot, shard) in the folder ``path``. A version is never written over."""
    rows = spark.createDataFrame(list(enumerate(at)), "virtual_slot long, shard int")
    rows.coalesce(1).write.mode("error").parquet(f"{path}/version={version}")


def read_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """(virtual_slot, shard) of a version of the map, the latest one where none is named."""
    versions = spark.read.schema("virtual_slot long, shard int, version int").parquet(path)
    if version is None:
        version = versions.agg(F.max("version")).first()[0]
    return versions.where(F.col("version") == version).select("virtual_slot", "shard")


def sharded(rows: DataFrame, slot_map: DataFrame) -> DataFrame:
    """``slotted`` rows with their shard. The map has SLOTS rows."""
    return rows.drop("shard").join(F.broadcast(slot_map), "virtual_slot")


def placed(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """A row per document: its shard, and its place there, without gaps from 0.

    Places are counted within slots, and each slot begins where the slots of its shard before it end, so that numbering
    takes as many tasks as there are slots, not shards.
    """
    spark = docs.sparkSession
    rows = stash(slotted(docs.select("doc_id", "text")).select("doc_id", "__size", "__crc", "virtual_slot"), "slotted")
    sums = sums_by_slot(rows)
    path = scratch_path(spark, "slot-map")
    at = first_map(sums, shards)
    write_map(spark, path, at, 1)
    before, starts = [0] * shards, []
    for slot in sorted(sums):
        starts.append((slot, before[at[slot]]))
        before[at[slot]] += sums[slot][1]
    begins = spark.createDataFrame(starts, "virtual_slot long, begin long")
    slot_map = read_map(spark, path).join(begins, "virtual_slot")
    inner = Window.partitionBy("virtual_slot").orderBy("doc_id", "__crc", "__size")
    return sharded(rows, slot_map).select(
        "doc_id", F.col("__size").alias("size"), F.col("__crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard",
        (F.col("begin") + F.row_number().over(inner) - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "virtual_slot",
    )
