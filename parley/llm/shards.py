"""Sharding by fixed virtual slots.

Records hash into a fixed number of slots; bytes and rows are added up per slot, and a versioned table says which shard
owns a slot. The number of slots never changes, so a rebalance only edits that table: records are not hashed again and
only the slots that change owner move. The table has one row per slot, a constant, and is the only thing that passes
through the driver or a broadcast.

Defined results: a null text counts as empty; a null doc_id hashes like any value; rows equal in doc_id and text share a
slot; an empty input gives an empty result and a map without loads; columns beside doc_id and text are ignored.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parley.llm.common import pick
from parley.session import stage

#: Virtual slots; far more than shards, so that slots are small against a shard.
SLOTS = 16_384
#: Bytes that a record takes beside its text.
ROW_BYTES = 16


def records(df: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, virtual_slot, size and text_crc32 of every row."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return pick(df, "doc_id", "text").select(
        "doc_id",
        F.pmod(F.xxhash64("doc_id", "text"), F.lit(slots)).cast("int").alias("virtual_slot"),
        (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
    )


def slot_loads(recs: DataFrame) -> dict[int, tuple[int, int]]:
    """Bytes and rows per slot; at most as many entries as there are slots."""
    rows = recs.groupBy("virtual_slot").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()
    return {r.virtual_slot: (r.b, r.n) for r in rows}


def assign(loads: dict[int, tuple[int, int]], shards: int, slots: int = SLOTS) -> dict[int, int]:
    """First map: slots by falling bytes, each to the shard that is lightest so far."""
    heap = [(0, s) for s in range(shards)]
    owner = {}
    for slot in sorted(range(slots), key=lambda s: (-loads.get(s, (0, 0))[0], s)):
        held, shard = heapq.heappop(heap)
        owner[slot] = shard
        heapq.heappush(heap, (held + loads.get(slot, (0, 0))[0], shard))
    return owner


def rebalance(owner: dict[int, int], loads: dict[int, tuple[int, int]], shards: int) -> dict[int, int]:
    """The next version of a map for new loads or another number of shards.

    Slots of shards that no longer exist are handed out first. Then slots move from the heaviest to the lightest shard,
    the largest that narrows the gap first, until none does. All other slots keep their owner.
    """
    size = {s: loads.get(s, (0, 0))[0] for s in owner}
    new = dict(owner)
    held = dict.fromkeys(range(shards), 0)
    own: dict[int, set[int]] = {s: set() for s in range(shards)}
    homeless = []
    for slot, shard in owner.items():
        if shard < shards:
            held[shard] += size[slot]
            own[shard].add(slot)
        else:
            homeless.append(slot)

    def give(slot: int, to: int) -> None:
        new[slot] = to
        held[to] += size[slot]
        own[to].add(slot)

    for slot in sorted(homeless, key=lambda s: (-size[s], s)):
        give(slot, min(held, key=lambda s: (held[s], s)))
    while True:
        heavy = max(held, key=lambda s: (held[s], -s))
        light = min(held, key=lambda s: (held[s], s))
        fits = [s for s in own[heavy] if 0 < 2 * size[s] <= held[heavy] - held[light]]
        if not fits:
            return new
        slot = max(fits, key=lambda s: (size[s], -s))
        own[heavy].discard(slot)
        held[heavy] -= size[slot]
        give(slot, light)


def map_frame(spark: SparkSession, owner: dict[int, int], loads: dict[int, tuple[int, int]], version: int = 1) -> DataFrame:
    """The map as a table: version, virtual_slot, shard, its load, and the rows of the shard in slots before it."""
    before: dict[int, int] = {}
    rows = []
    for slot in sorted(owner):
        shard = owner[slot]
        size, n = loads.get(slot, (0, 0))
        rows.append((version, slot, shard, size, n, before.get(shard, 0)))
        before[shard] = before.get(shard, 0) + n
    return spark.createDataFrame(rows, "version int, virtual_slot int, shard int, slot_bytes long, slot_rows long, rows_before long")


def place_rows(recs: DataFrame, slot_map: DataFrame) -> DataFrame:
    """Shard of every record, and its place in the shard counted from 0 without gaps.

    Places run slot by slot: the rows of earlier slots come from the map, and only the rows of one slot are ordered
    together. The map has one row per slot, so its broadcast does not grow with the records.
    """
    within = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    return (
        recs.withColumn("place", F.row_number().over(within) - 1)
        .join(F.broadcast(slot_map.select("virtual_slot", "shard", "rows_before")), "virtual_slot")
        .withColumn("slot", (F.col("rows_before") + F.col("place")).cast("long"))
        .drop("place", "rows_before")
    )


def shard_documents(df: DataFrame, shards: int = 40, slots: int = SLOTS) -> tuple[DataFrame, DataFrame]:
    """Placed records and the first version of the map, both staged in the shared folder."""
    recs = stage(records(df, slots))
    loads = slot_loads(recs)
    slot_map = stage(map_frame(df.sparkSession, assign(loads, shards, slots), loads))
    return place_rows(recs, slot_map), slot_map


def shard_column(df: DataFrame, slot_map: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id and text of df with the shard that the map gives them, for a partitioned write."""
    keyed = pick(df, "doc_id", "text").select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(slots)).cast("int").alias("virtual_slot"), F.struct("doc_id", "text").alias("record"))
    return keyed.join(F.broadcast(slot_map.select("virtual_slot", "shard")), "virtual_slot").select("record.*", "shard")


def law() -> Column:
    """Sizes are near equal: the map is made and edited by bytes."""
    return F.lit("bytes")
