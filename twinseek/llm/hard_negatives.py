"""Hard negatives by inner product, scored in a residue number system.

Components are whole numbers, floor(256 x). A block of anchors and a shard of rows are multiplied modulo several small primes: balanced
residues are small enough that a product over WIDTH components is exact in float32, so each prime costs one float32 matrix product.
The primes are as many as the range of the scores asks for; Chinese remaindering (mixed radix, balanced digits) then gives the exact
signed scores.

Two searches of that kind follow one another. The first finds each anchor's positives, its best rows of the same label; anchors and
rows meet by bucket of their label, block and shard. The second finds, for each anchor and positive, the best rows of other
labels whose score lies in the window that the positive's score opens. Every shard gives at most k rows per anchor (and positive),
and a ranking window over those picks the first k. Shards are hash classes of rows, so a label or a vector that holds a third of all
rows is spread over all of them.

Defined cases: rows with a null label, a null vector or a null or non-finite component take no part; only vectors of equal length
meet; each row of a repeated id is an anchor, positive or negative of its own; null ids lose ties and are no anchors; scores beyond 64 bits
count as the largest or smallest number of 64 bits; a negative positive score opens an empty window; an empty table gives no rows.
"""

from __future__ import annotations

from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from twinseek.llm.common import stored

SCALE = 256
SHARD_ROWS, BLOCK_ANCHORS = 8192, 2048
# Anchors scored at once against a shard, and classes of labels that the search of positives is dealt by.
STRIP, LABEL_BUCKETS = 64, 16
# Components of one exact product, and the largest number that its sums and their remainders may reach in float32.
WIDTH, EXACT = 64, (1 << 24) - (1 << 11)
LIMIT = (1 << 63) - 1
NO_SCORE = -LIMIT - 1
# A negative's score lies between these hundredths of the positive's.
LOW, HIGH = 30, 90
FOUND = "anchor long, place int, row long, vec_id long, score long"


def whole_numbers(vectors: Column) -> Column:
    """floor(256 x) of every component; null where the vector takes no part."""
    finite = F.forall(vectors, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    scaled = F.transform(vectors, lambda x: F.floor(F.lit(SCALE) * x.cast("double")).cast("long"))
    return F.when(finite, scaled)


def moduli(bound: int) -> list[int]:
    """Primes, the largest first, whose product tells apart all numbers from -bound to bound."""
    found: list[int] = []
    product = 1
    n = 2 * isqrt(EXACT // WIDTH) + 1
    while product <= 2 * bound:
        if all(n % d for d in range(3, isqrt(n) + 1, 2)):
            found.append(n)
            product *= n
        n -= 2
    return found


def balanced(numbers: np.ndarray, prime: int) -> np.ndarray:
    """Remainders between -prime/2 and prime/2."""
    left = numbers % prime
    return np.where(left > prime // 2, left - prime, left)


def residue_product(left: np.ndarray, right: np.ndarray, prime: int) -> np.ndarray:
    """left @ right.T modulo a prime, of balanced float32 remainders; exact, as no sum reaches 2^24."""
    total = np.zeros((len(left), len(right)), np.float32)
    for start in range(0, left.shape[1], WIDTH):
        part = left[:, start : start + WIDTH] @ right[:, start : start + WIDTH].T
        total += part - np.rint(part * np.float32(1 / prime)) * np.float32(prime)
    return total


class Shard:
    """Whole vectors prepared for exact products with many anchors."""

    def __init__(self, vectors: np.ndarray, anchors: np.ndarray):
        # no score exceeds the sum of the products of the greatest components
        reach = [[int(x) for x in m.astype(object).__abs__().max(axis=0)] if len(m) else [] for m in (vectors, anchors)]
        self.bound = sum(x * y for x, y in zip(*reach, strict=False))
        self.primes = moduli(max(self.bound, 1))
        self.anchors = anchors
        self.parts = [balanced(vectors, p).astype(np.float32) for p in self.primes]

    def scores(self, at: slice) -> np.ndarray:
        """Exact scores of some anchors against all rows, as numbers of 64 bits."""
        kind = np.int64 if self.bound < 1 << 61 else object
        value: np.ndarray | int = 0
        product = 1
        for prime, part in zip(self.primes, self.parts, strict=True):
            own = balanced(self.anchors[at], prime).astype(np.float32)
            remainder = residue_product(own, part, prime).astype(np.int64).astype(kind)
            digit = (remainder - value) % prime * pow(product, -1, prime) % prime
            value = value + np.where(digit > prime // 2, digit - prime, digit) * product
            product *= prime
        return np.clip(value, -LIMIT, LIMIT).astype(np.int64)


def best(scores: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the k best allowed scores of every row; the first columns among equal ones."""
    keep = allowed
    if scores.shape[1] > k:
        scores = np.where(allowed, scores, NO_SCORE)
        last = np.partition(scores, -k, axis=1)[:, -k, None]
        above = scores > last
        equal = allowed & (scores == last)
        need = k - above.sum(axis=1, keepdims=True)
        keep = above | (equal & (np.cumsum(equal, axis=1, dtype=np.int32) <= need))
    return np.nonzero(keep)


def bounds(positive: int) -> tuple[int, int]:
    """Least and greatest score s with 30 p <= 100 s <= 90 p."""
    return -(-LOW * positive // 100), HIGH * positive // 100


def _table(column: pa.ChunkedArray, rows: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def _search(k: int, same: bool):
    """The k best rows of the anchor's label, or of others inside each of its windows, of one block and shard."""

    def search(key: tuple, block: pa.Table, shard: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] * 4]
        if block.num_rows and shard.num_rows:
            # equal scores rank by id, so the columns stand in order of ids
            shard = shard.sort_by([("vec_id", "ascending"), ("row", "ascending")])
            prepared = Shard(_table(shard.column("vector"), shard.num_rows), _table(block.column("vector"), block.num_rows))
            labels, own = shard.column("label").to_numpy(), block.column("label").to_numpy()
            rows, anchors = shard.column("row").to_numpy(), block.column("row").to_numpy()
            windows = None if same else [[bounds(p) for p in ps] for ps in block.column("positives").to_pylist()]
            for start in range(0, len(anchors), STRIP):
                at = slice(start, start + STRIP)
                scores = prepared.scores(at)
                alike = own[at, None] == labels
                if same:
                    found = [(0, alike & (anchors[at, None] != rows))]
                else:
                    found = []
                    for place in range(max(map(len, windows[at]))):
                        # an anchor with fewer positives gets an empty window
                        low, high = np.array([w[place] if place < len(w) else (1, 0) for w in windows[at]]).T[..., None]
                        found.append((place, ~alike & (low <= scores) & (scores <= high)))
                for place, allowed in found:
                    i, j = best(scores, allowed, k)
                    out.append([anchors[start + i], np.full(len(i), place), j, scores[i, j]])
        anchor, place, column, score = (np.concatenate(x) for x in zip(*out, strict=True))
        taken = shard.select(["row", "vec_id"]).take(pa.array(column))
        return pa.table(
            [pa.array(anchor), pa.array(place, pa.int32()), *taken.columns, pa.array(score)],
            ["anchor", "place", "row", "vec_id", "score"],
        )

    return search


def _met(asking: DataFrame, rows: DataFrame, shards: int, blocks: int, k: int, same: bool) -> DataFrame:
    """All anchors against all rows in groups of one block and one shard, then the k best of all shards, ranked."""
    bucket = F.pmod(F.xxhash64("label"), F.lit(LABEL_BUCKETS)) if same else F.lit(0)

    def dealt(own: str, n: int, other: str, m: int, table: DataFrame) -> DataFrame:
        # columns of new names, as both sides derive from one table
        return table.select(
            *[F.col(c).alias(c) for c in table.columns],
            bucket.cast("int").alias("bucket"),
            F.pmod(F.xxhash64("row", F.lit(own)), F.lit(n)).cast("int").alias(own),
            F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias(other),
        )

    keys = ["length", "bucket", "block", "shard"]
    left = dealt("block", blocks, "shard", shards, asking).groupBy(*keys)
    right = dealt("shard", shards, "block", blocks, rows).groupBy(*keys)
    found = left.cogroup(right).applyInArrow(_search(k, same), FOUND)
    order = Window.partitionBy("anchor", "place").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "row")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mine(vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 10) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of (vec_id, embedding, label).

    `anchors` says which rows are anchors.
    """
    numbered = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("label").cast("long").alias("label"),
        whole_numbers(F.col("embedding")).alias("vector"),
        F.coalesce(anchors, F.lit(False)).alias("asks"),
    ).filter(F.col("vector").isNotNull() & F.col("label").isNotNull())
    rows = stored(numbered.withColumn("row", F.monotonically_increasing_id()).withColumn("length", F.size("vector")), "vectors")
    sizes = rows.agg(F.count("*").alias("n"), F.count_if("asks").alias("q")).first()
    shards = max(1, -(-sizes["n"] // SHARD_ROWS))
    blocks = max(1, -(-sizes["q"] // BLOCK_ANCHORS))
    asking = rows.filter("asks").drop("asks")
    rows = rows.drop("asks")
    near = _met(asking, rows, shards, blocks, positives, same=True)
    near = stored(near.select("anchor", "rank", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    # positives in the order of their ranks: at most `positives` an anchor
    listed = near.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("rank", "positive_score"))).alias("of"))
    opened = asking.join(listed.select(F.col("anchor").alias("row"), F.col("of.positive_score").alias("positives")), "row")
    far = _met(opened, rows, shards, blocks, negatives, same=False).select(
        "anchor", "place", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")
    )
    pairs = near.withColumn("place", F.col("rank") - 1).drop("rank")
    named = pairs.join(asking.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id")), "anchor")
    return far.join(named, ["anchor", "place"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )
