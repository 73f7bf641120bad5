"""Mixing sources to target weights by cube-method balanced sampling.

Targets: sources share a multiple of all sizes by weight; no source gets more than `most` times its size, and what is above is
shared again by weight. A document of source s is wanted target / size times: the whole part is taken for sure, and the
fraction is its inclusion probability in a balanced sample. The cube method moves the probabilities of three documents at a
time along the null space of the constraints (tokens and documents of the source), until one of them is 0 or 1; expected and
balanced totals stay the same at every step. Documents are dealt to blocks of bounded size; what a block leaves open (two
documents at most) goes into blocks of blocks, until one small landing problem per source remains, which is solved by trying
its subsets for the total nearest to the target.

Randomness is seeded by block and source, blocks are chosen by hash and sorted inside, so reruns agree whatever the number of
executors or splits.

Defined cases: a null text has size 0 and is never taken more than its source asks; the null source is a source and weighs last; null
ids are ordinary; repeated rows are separate documents; an empty table gives an empty mix.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from twinseek.llm.common import stored, word_count

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
# Documents of one block of the first flight, and blocks that are gathered into one of the next.
BLOCK_ROWS, GATHERED = 1024, 256
# Probabilities this near to 0 or 1 count as settled.
NEAR = 1e-9
SETTLED = "__block long, source string, doc_id {id}, size long, whole int, chance double"


def numbered_sources(totals: DataFrame, weights: Sequence[float] = WEIGHTS) -> DataFrame:
    """Sources with their weight by code-point order, null last. Numbered by counting, never by sorting in one task."""
    parts = F.spark_partition_id().alias("__part")
    ordered = stored(totals.repartitionByRange(F.col("source").asc_nulls_last()).select("*", parts), "sources")
    counts = {r["__part"]: r["n"] for r in ordered.groupBy("__part").agg(F.count("*").alias("n")).collect()}
    before = dict(zip(sorted(counts), itertools.accumulate([0, *[counts[p] for p in sorted(counts)]]), strict=False))
    starts = F.create_map(*[F.lit(x) for pair in before.items() for x in pair]) if before else F.create_map()
    place = F.row_number().over(Window.partitionBy("__part").orderBy(F.col("source").asc_nulls_last())) - 1
    start = F.coalesce(starts[F.col("__part")], F.lit(0)) if before else F.lit(0)
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(place + start, F.lit(len(weights)))).cast("int"))
    return ordered.withColumn("weight", weight).drop("__part")


def with_targets(sources: DataFrame, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Target of each source. Each round is one distributed sum; only its two numbers reach the driver."""
    limit = F.col("source_size") * F.lit(most)
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    wanted = share * total
    level = 0.0
    while True:
        over = limit <= F.col("weight") * F.lit(level)
        row = sources.agg(
            F.coalesce(F.sum(F.when(over, limit)), F.lit(0.0)).alias("held"),
            F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0.0)).alias("weight"),
        ).first()
        if not row["weight"]:
            break
        risen = (wanted - row["held"]) / row["weight"]
        if risen <= level * (1 + 1e-12):
            break
        level = risen
    return sources.withColumn("target", F.least(limit, F.col("weight") * F.lit(level)))


def seed_of(block: int | None, source: str | None) -> int:
    digest = hashlib.sha256(f"{block}\0{'' if source is None else 's' + source}".encode()).digest()
    return int.from_bytes(digest[:8], "little")


def flight(chance: np.ndarray, size: np.ndarray, random: np.random.Generator) -> np.ndarray:
    """Move probabilities through the null space of (count, size) until at most two are between 0 and 1."""
    p = chance.tolist()
    s = size.tolist()
    held: list[int] = []
    draws = iter(random.random(len(p) + 3).tolist())

    def step(units: list[int]) -> list[int]:
        if len(units) == 3:
            a, b, c = (s[i] for i in units)
            move = [float(b - c), float(c - a), float(a - b)]
            if not any(move):
                move = [1.0, -1.0, 0.0]
        else:
            move = [1.0, -1.0]
        up = min((1 - p[i]) / m if m > 0 else p[i] / -m for i, m in zip(units, move, strict=True) if m)
        down = min(p[i] / m if m > 0 else (1 - p[i]) / -m for i, m in zip(units, move, strict=True) if m)
        length = up if next(draws) * (up + down) < down else -down
        for i, m in zip(units, move, strict=True):
            q = p[i] + length * m
            p[i] = 0.0 if q < NEAR else 1.0 if q > 1 - NEAR else q
        return [i for i in units if 0 < p[i] < 1]

    for i in range(len(p)):
        if 0 < p[i] < 1:
            held.append(i)
            while len(held) == 3:
                held = step(held)
    # two of equal size can still move without a change of either total
    if len(held) == 2 and s[held[0]] == s[held[1]]:
        step(held)
    return np.array(p)


def landing(chance: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Settle the few open probabilities (two after a flight): the subset whose tokens, then documents, are nearest to what is wanted."""
    open_ = np.flatnonzero((chance > 0) & (chance < 1))
    tokens, count = float((chance * size)[open_].sum()), float(chance[open_].sum())
    best = min(
        itertools.product((0.0, 1.0), repeat=len(open_)),
        key=lambda pick: (
            abs(sum(x * y for x, y in zip(pick, size[open_].tolist(), strict=True)) - tokens),
            abs(sum(pick) - count),
            pick,
        ),
    )
    settled = chance.copy()
    settled[open_] = best
    return settled


def _cube(last: bool):
    def block(table: pa.Table) -> pa.Table:
        # id, size: rows that agree in both are alike, so their order does not matter
        table = table.sort_by([("doc_id", "ascending"), ("size", "ascending"), ("chance", "ascending")])
        size = table.column("size").to_numpy()
        key, source = table.column("__block")[0].as_py(), table.column("source")[0].as_py()
        chance = flight(table.column("chance").to_numpy(), size, np.random.default_rng(seed_of(key, source)))
        if last:
            chance = landing(chance, size)
        return table.set_column(table.schema.get_field_index("chance"), "chance", pa.array(chance))

    return block


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """doc_id, source, size, source_size, target, whole and chosen (0 or 1): a document is taken whole + chosen times."""
    sized = stored(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "sizes")
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    sources = stored(with_targets(numbered_sources(totals, weights), share, most), "targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    known = sources.select(F.col("source").alias("__s"), rate.alias("rate"), F.ceil(F.col("n") / BLOCK_ROWS).alias("blocks"))
    # a probability that is whole but for rounding needs no sample
    tidy = F.when(F.abs(F.col("rate") - F.round("rate")) < NEAR, F.round("rate")).otherwise(F.col("rate"))
    schema = SETTLED.format(id=sized.schema["doc_id"].dataType.simpleString())
    open_ = sized.join(known, F.col("source").eqNullSafe(F.col("__s"))).select(
        F.pmod(F.xxhash64("doc_id", "size"), F.col("blocks")).cast("long").alias("__block"),
        "source",
        "doc_id",
        "size",
        F.floor(tidy).cast("int").alias("whole"),
        (tidy - F.floor(tidy)).alias("chance"),
    )
    most_blocks = sources.agg(F.max(F.ceil(F.col("n") / BLOCK_ROWS))).first()[0] or 1
    fractional = (F.col("chance") > 0) & (F.col("chance") < 1)
    settled = []
    while True:
        last = most_blocks <= 1
        flown = stored(open_.groupBy("__block", "source").applyInArrow(_cube(last), schema), "flight")
        settled.append(flown.filter(~fractional))
        if last:
            break
        most_blocks = -(-most_blocks // GATHERED)
        open_ = flown.filter(fractional).withColumn("__block", F.floor(F.col("__block") / GATHERED).cast("long"))
    every = settled[0]
    for part in settled[1:]:
        every = every.unionByName(part)
    targets = sources.select(F.col("source").alias("__s"), "source_size", "target")
    return every.join(targets, F.col("source").eqNullSafe(F.col("__s"))).select(
        "doc_id", "source", "size", "source_size", "target", "whole", F.col("chance").cast("int").alias("chosen")
    )


def taken_rows(docs: DataFrame, **settings) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with all their columns.

    Decisions are matched to rows by id, source and size; rows that agree in all three share the decisions in any order.
    """
    counted = docs.select(F.struct("*").alias("__row"), "doc_id", "source", word_count(F.col("text")).alias("__size"))
    keys = ["doc_id", "source", "__size"]
    chosen = (
        mix(docs, **settings)
        .groupBy("doc_id", "source", F.col("size").alias("__size"))
        .agg(F.max("whole").alias("__whole"), F.sum("chosen").alias("__chosen"))
    )
    marked = [F.struct(*keys).alias("__key")]
    left = counted.select("__row", *marked)
    right = chosen.select("__whole", "__chosen", *marked)
    order = F.row_number().over(Window.partitionBy("__key").orderBy(F.lit(0)))
    times = F.col("__whole") + (F.col("__place") <= F.col("__chosen")).cast("int")
    return (
        left.join(right, "__key")
        .withColumn("__place", order)
        .withColumn("__copy", F.explode(F.when(times > 0, F.sequence(F.lit(1), times)).otherwise(F.array().cast("array<int>"))))
        .select("__row.*")
    )
