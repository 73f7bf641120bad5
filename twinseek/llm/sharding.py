"""Sharding by fixed virtual slots with a stored, versioned map from slots to shards.

A record is hashed into one of thousands of slots for good; only the map from slots to shards changes. The map is built from
the bytes of each slot (largest slot first onto the lightest shard), so shards get nearly equal bytes, and is edited when
shards are added: slots move, records inside a slot never part. Slots are hashed over (doc_id, size, checksum), so a null or
much repeated id does not fill one slot.

Defined cases: a null text has no bytes and the checksum of the empty text; a null id is an ordinary value; repeated rows share
a slot and get positions of their own; an empty table gives an empty result and an even map.
"""

from __future__ import annotations

import heapq
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from twinseek.llm.common import shared, stored, whole_text

SLOTS = 4096
# A rebalance stops when the heaviest shard is within this share above the mean.
TOLERANCE = 0.01

Loads = Mapping[int, int]


def records(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, virtual_slot of each row; the text itself stays behind."""
    text = whole_text()
    sized = docs.select(
        "doc_id",
        (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
    )
    slot = F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.lit(slots)).cast("int")
    return sized.withColumn("virtual_slot", slot)


def slot_loads(rows: DataFrame) -> dict[int, tuple[int, int]]:
    """Bytes and rows of each slot: at most one row per slot reaches the driver."""
    found = rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect()
    return {r["virtual_slot"]: (r["bytes"], r["rows"]) for r in found}


def build_map(loads: Loads, shards: int, slots: int = SLOTS) -> dict[int, int]:
    """A first map: slots by falling bytes, each to the shard that is lightest so far."""
    heap = [(0, 0, shard) for shard in range(shards)]
    placed = {}
    for slot in sorted(range(slots), key=lambda s: (-loads.get(s, 0), s)):
        load, count, shard = heapq.heappop(heap)
        placed[slot] = shard
        heapq.heappush(heap, (load + loads.get(slot, 0), count + 1, shard))
    return placed


def edit_map(placed: Mapping[int, int], loads: Loads, shards: int, tolerance: float = TOLERANCE) -> dict[int, int]:
    """The map for `shards` shards with few moves: slots leave shards that are gone or too heavy, all others stay."""
    edited = dict(placed)
    weight = [0] * shards
    homeless = []
    members: list[list[tuple[int, int]]] = [[] for _ in range(shards)]
    for slot, shard in placed.items():
        if shard < shards:
            weight[shard] += loads.get(slot, 0)
            heapq.heappush(members[shard], (-loads.get(slot, 0), slot))
        else:
            homeless.append(slot)
    for slot in sorted(homeless, key=lambda s: (-loads.get(s, 0), s)):
        to = min(range(shards), key=lambda s: (weight[s], s))
        edited[slot] = to
        weight[to] += loads.get(slot, 0)
        heapq.heappush(members[to], (-loads.get(slot, 0), slot))
    mean = sum(weight) / shards
    # shards that are new take what the others give; between old ones nothing moves then
    takers = sorted({*range(shards)} - {*edited.values()}) or range(shards)
    while True:
        heavy, light = max(range(shards), key=lambda s: weight[s]), min(takers, key=lambda s: weight[s])
        gap = weight[heavy] - weight[light]
        fitting = [x for x in members[heavy] if 0 < -x[0] < gap]
        if weight[heavy] <= mean * (1 + tolerance) or not fitting:
            return edited
        move = min(fitting, key=lambda x: (abs(-x[0] * 2 - gap), x[1]))
        members[heavy].remove(move)
        heapq.heapify(members[heavy])
        heapq.heappush(members[light], move)
        weight[heavy] += move[0]
        weight[light] -= move[0]
        edited[move[1]] = light


def write_map(spark: SparkSession, folder: str, version: int, placed: Mapping[int, int]) -> None:
    """Store one version of the map; versions are never overwritten."""
    table = spark.createDataFrame(sorted(placed.items()), "virtual_slot int, shard int").coalesce(1)
    table.write.parquet(f"{folder}/map_version={version}")


def read_map(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """One version of the map, by default the newest: virtual_slot, shard, map_version."""
    maps = spark.read.parquet(folder)
    if version is None:
        version = maps.agg(F.max("map_version")).first()[0]
    return maps.filter(F.col("map_version") == version)


def shard(docs: DataFrame, shards: int, slots: int = SLOTS, folder: str | None = None) -> DataFrame:
    """Shard and position of each document under a newly built map (version 1 in `folder`).

    Positions are gapless in a shard: slots follow each other in the order of their numbers, rows inside a slot by id. The
    number of rows before a slot comes from the slot counts, so no shard is ever numbered in one task.
    """
    spark = docs.sparkSession
    rows = stored(records(docs, slots), "records")
    loads = slot_loads(rows)
    placed = build_map({s: b for s, (b, _) in loads.items()}, shards, slots)
    folder = folder or f"{shared(spark)}/slot-map-{spark.sparkContext.applicationId}-{id(rows)}"
    write_map(spark, folder, 1, placed)
    before, filled = [], [0] * shards
    for slot in range(slots):
        before.append((slot, filled[placed[slot]]))
        filled[placed[slot]] += loads.get(slot, (0, 0))[1]
    # both tables have exactly one row per slot, a fixed number, so they may be sent to every executor
    offsets = spark.createDataFrame(before, "virtual_slot int, before long")
    lookup = read_map(spark, folder).join(F.broadcast(offsets), "virtual_slot")
    order = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    return (
        rows.withColumn("place", F.row_number().over(order) - 1)
        .join(F.broadcast(lookup), "virtual_slot")
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            "shard",
            (F.col("place") + F.col("before")).alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
            "virtual_slot",
            "map_version",
        )
    )
