"""Semantic search: nearest chunks by inner product, for one query or a batch."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinseek.functions import vectors
from twinseek.operators.ranking import top_k, top_k_per_query
from twinseek.session import cut_lineage

# Bound on a batch that is sent to every executor, and on a block of a larger one: query rows, and bytes of query vectors.
PASS_ROWS = 20_000
PASS_BYTES = 64 << 20
# Bytes of chunk vectors that meet a block of queries at once, and classes that scopes are dealt by.
SHARD_BYTES = 64 << 20
SCOPE_BUCKETS = 64
# Chunks of a shard that are scored at once.
SHARD_BATCH = 8192
# Query columns scored at once against one Arrow batch.
SCORE_BLOCK = 256
# Scopes up to this many distinct values are also pushed into the chunk scan.
PUSHED_SCOPES = 1_000
# Rows of a batch, as a multiple of k, that may pass a query's bound without a selection.
PASSED = 8
# Slack kept around the k-th best while scores still carry rounding noise of the block product.
SLACK = 1e-9


@dataclass(frozen=True)
class Scope:
    """`chunks.column` must equal `queries.query_column`."""

    column: str
    query_column: str


@dataclass(frozen=True)
class Range:
    """`chunks.column` must lie between `queries.low` and `queries.high`."""

    column: str
    low: str
    high: str


def nearest(chunks: DataFrame, embedding: Sequence[float], k: int = 40, keep: Sequence[str] = ()) -> DataFrame:
    """One query: distance of every chunk, best k. Stays in the JVM; filters on `chunks` reach the scan."""
    query = vectors.vector_literal(embedding)
    distance = vectors.negative_inner_product(
        vectors.require_dimension(F.col("embedding"), len(embedding)), query
    ).alias("distance")
    scored = chunks.filter(F.col("embedding").isNotNull()).select("id", *keep, distance)
    return top_k(scored, "distance", k)


def nearest_batch(
    queries: DataFrame,
    chunks: DataFrame,
    k: int,
    scopes: Sequence[Scope] = (),
    ranges: Sequence[Range] = (),
    keep: Sequence[str] = (),
    n_queries: int | None = None,
    pass_rows: int = PASS_ROWS,
    pass_bytes: int = PASS_BYTES,
) -> DataFrame:
    """For every query its k nearest chunks: `query_id, id, *keep, distance, rank` (`keep`: non-null integer columns).

    Up to a measured size the query vectors travel to the executors. Chunks are then read where they lie and never shuffled: each task
    scores its Arrow batches against the query vectors with a block product and keeps k rows per query, so pairs are never written
    out and a tenant of any size spreads over all its splits. A larger batch meets the chunks by shuffle (`nearest_shuffled`), with
    the same result. `n_queries` is the number of queries when it is known.
    """
    wanted = _wanted(queries, scopes, ranges)
    n = wanted.count() if n_queries is None else n_queries
    batch = wanted.toArrow() if n <= pass_rows else None
    if batch is not None and batch.nbytes <= pass_bytes:
        return top_k_per_query(_one_pass(batch, chunks, k, scopes, ranges, keep), "distance", k)
    del batch
    return nearest_shuffled(queries, chunks, k, scopes, ranges, keep, pass_rows, pass_bytes)


def nearest_shuffled(
    queries: DataFrame,
    chunks: DataFrame,
    k: int,
    scopes: Sequence[Scope] = (),
    ranges: Sequence[Range] = (),
    keep: Sequence[str] = (),
    block_rows: int = PASS_ROWS,
    block_bytes: int = PASS_BYTES,
    shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """The same for any number of queries; no query vector passes the driver.

    Queries are dealt into blocks, chunks into shards, both by hash and both by class of their scope, and every block meets every shard of
    its class in one group. Shard 0 of each class goes first: the distance of a query's k-th row there bounds what the other
    shards need to hand on, so they add few rows to it. A chunk is shuffled once for every block of its class.
    """
    spark = chunks.sparkSession
    bucket = F.pmod(F.xxhash64("scope"), F.lit(SCOPE_BUCKETS)).cast("int").alias("bucket")
    asked = cut_lineage(_wanted(queries, scopes, ranges).select("*", bucket))
    # at most SCOPE_BUCKETS rows
    counted = asked.groupBy("bucket").agg(F.count("*").alias("n"), F.max(F.size("query_embedding")).alias("d")).collect()
    schema = ", ".join(["query_id long", *[f"{c} long" for c in ["id", *keep]], "distance double"])
    if not counted:
        return top_k_per_query(spark.createDataFrame([], schema), "distance", k)
    dimension = max(r["d"] for r in counted)
    per_block = max(1, min(block_rows, block_bytes // (4 * dimension)))
    blocks = max(-(-r["n"] // per_block) for r in counted)
    rows = _scored_columns(chunks, scopes, ranges, keep).select("*", bucket)
    rows = rows.filter(F.col("bucket").isin([r["bucket"] for r in counted]))
    shards = max(1, -(-rows.count() * 4 * dimension // shard_bytes))
    shard = F.pmod(F.xxhash64("id", F.lit("shard")), F.lit(shards)).cast("int")
    block = F.pmod(F.xxhash64("query_id", F.lit("block")), F.lit(blocks)).cast("int")
    keys = ["bucket", "block", "shard"]

    def met(asking: DataFrame, first: int, last: int) -> DataFrame:
        """Blocks against the shards from `first` to `last`."""
        left = asking.select("*", block.alias("block"), F.explode(F.sequence(F.lit(first), F.lit(last))).alias("shard"))
        right = rows.select("*", shard.alias("shard")).filter(F.col("shard").between(first, last))
        right = right.select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_block_search(k, ["id", *keep], len(ranges)), schema)

    found = top_k_per_query(met(asked.withColumn("bound", F.lit(float("inf"))), 0, 0), "distance", k)
    if shards == 1:
        return found
    found = cut_lineage(found)
    kth = found.filter(F.col("rank") == k).select("query_id", F.col("distance").alias("kth"))
    bounded = asked.join(kth, "query_id", "left").withColumn("bound", F.coalesce("kth", F.lit(float("inf")))).drop("kth")
    return top_k_per_query(found.drop("rank").unionByName(met(bounded, 1, shards - 1)), "distance", k)


def _wanted(queries: DataFrame, scopes: Sequence[Scope], ranges: Sequence[Range]) -> DataFrame:
    """Queries that can find anything, in the columns that scoring needs."""
    wanted = queries.filter(F.col("query_embedding").isNotNull())
    for s in scopes:
        wanted = wanted.filter(F.col(s.query_column).isNotNull())
    return wanted.select(
        F.col("query_id").cast("long").alias("query_id"),
        F.col("query_embedding").cast("array<float>").alias("query_embedding"),
        scope_key([F.col(s.query_column) for s in scopes]).alias("scope"),
        F.array(*[F.col(r.low).cast("double") for r in ranges]).cast("array<double>").alias("low"),
        F.array(*[F.col(r.high).cast("double") for r in ranges]).cast("array<double>").alias("high"),
        *[F.col(s.query_column).alias(f"scope_{i}") for i, s in enumerate(scopes)],
    )


def _scored_columns(chunks: DataFrame, scopes: Sequence[Scope], ranges: Sequence[Range], keep: Sequence[str]) -> DataFrame:
    """Chunks with an embedding, in the columns that scoring needs."""
    return chunks.filter(F.col("embedding").isNotNull()).select(
        *[F.col(c).cast("long").alias(c) for c in ["id", *keep]],
        scope_key([F.col(s.column) for s in scopes]).alias("scope"),
        F.array(*[F.col(r.column).cast("double") for r in ranges]).cast("array<double>").alias("ranges"),
        F.col("embedding").cast("array<float>").alias("embedding"),
    )


def scope_key(columns: list[Column]) -> Column:
    """Equality on several columns as equality on one text key; null when any part is null."""
    if not columns:
        return F.lit("")
    parts = [F.concat(F.length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")) for c in columns]
    return F.concat(*parts)


class _Asked:
    """Query vectors of a pass or block, ready to score Arrow columns of chunks."""

    def __init__(self, batch: pa.Table, carried: Sequence[str], n_ranges: int):
        self.carried, self.n_ranges = carried, n_ranges
        self.ids = np.asarray(batch["query_id"].combine_chunks())
        self.dimension, self.matrix = matrix_of(batch["query_embedding"].combine_chunks(), None)
        self.low = _bounds(batch["low"], n_ranges)
        self.high = _bounds(batch["high"], n_ranges)
        self.members = _members(np.array(batch["scope"].to_pylist(), dtype=object))

    def score(self, chunks: pa.RecordBatch, best: TopRows) -> None:
        """Add the chunks of one Arrow batch to what is best so far."""
        chunk = np.stack([np.asarray(chunks[c]) for c in self.carried])
        _, vectors_ = matrix_of(chunks["embedding"], self.dimension)
        values = _bounds(chunks["ranges"], self.n_ranges)
        for key, rows_ in _members(np.array(chunks["scope"].to_pylist(), dtype=object)).items():
            who = self.members.get(key)
            if who is None:
                continue
            x = vectors_[rows_]
            for start in range(0, len(who), SCORE_BLOCK):
                block = who[start : start + SCORE_BLOCK]
                distance = -(x @ self.matrix[block].T)
                for r in range(self.n_ranges):
                    v = values[rows_, r][:, None]
                    distance[~((v >= self.low[block, r]) & (v <= self.high[block, r]))] = np.inf
                best.add(distance, chunk[:, rows_], block, x, self.matrix)
        best.settle()


def _one_pass(
    batch: pa.Table,
    chunks: DataFrame,
    k: int,
    scopes: Sequence[Scope],
    ranges: Sequence[Range],
    keep: Sequence[str],
) -> DataFrame:
    spark = chunks.sparkSession
    carried = ["id", *keep]
    schema = ", ".join(["query_id long", *[f"{c} long" for c in carried], "distance double"])
    if batch.num_rows == 0:
        return spark.createDataFrame([], schema)
    asked = _Asked(batch, carried, len(ranges))
    rows = chunks
    for i, s in enumerate(scopes):
        values = batch[f"scope_{i}"].unique().to_pylist()
        if len(values) <= PUSHED_SCOPES:
            rows = rows.filter(F.col(s.column).isin(values))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = TopRows(asked.ids, k, carried)
        for b in batches:
            if b.num_rows:
                asked.score(b, best)
        yield best.batch()

    return _scored_columns(rows, scopes, ranges, keep).mapInArrow(score, schema)


def _block_search(k: int, carried: Sequence[str], n_ranges: int):
    """One block of queries against one shard, from which only rows within a query's bound are handed on."""

    def search(key: tuple, block: pa.Table, shard: pa.Table) -> pa.Table:
        if not block.num_rows:
            return pa.Table.from_batches([TopRows(np.array([], dtype=np.int64), k, carried).batch()])
        asked = _Asked(block, carried, n_ranges)
        best = TopRows(asked.ids, k, carried, np.asarray(block["bound"].combine_chunks()))
        for batch in shard.combine_chunks().to_batches(SHARD_BATCH):
            asked.score(batch, best)
        return pa.Table.from_batches([best.batch()])

    return search


def _members(keys: np.ndarray) -> dict:
    """Row indexes per key."""
    codes, index = np.unique(keys.astype(str), return_inverse=True)
    order = np.argsort(index, kind="stable")
    cuts = np.searchsorted(index[order], np.arange(1, len(codes)))
    return dict(zip(codes, np.split(order, cuts)))


def matrix_of(lists: pa.Array, dimension: int | None) -> tuple[int, np.ndarray]:
    """Equal-length float lists as a double matrix; a vector of another width fails the job."""
    lengths = np.asarray(lists.value_lengths())
    dimension = int(lengths[0]) if dimension is None else dimension
    if (lengths != dimension).any():
        raise ValueError(f"expected {dimension} dimensions, not {int(lengths[lengths != dimension][0])}")
    return dimension, np.asarray(lists.flatten()).astype(np.float64).reshape(len(lengths), dimension)


def _bounds(lists: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(lists), width)


class TopRows:
    """Running k nearest per query inside one task. `carried` names the chunk columns, the id first."""

    def __init__(self, query_ids: np.ndarray, k: int, carried: Sequence[str], bound: np.ndarray | None = None):
        self.query_ids, self.k, self.carried = query_ids, k, carried
        # no distance above it can be among the k nearest
        self.kth = np.full(len(query_ids), np.inf) if bound is None else bound.copy()
        self.query = [np.array([], dtype=np.int64)]
        self.chunk = [np.empty((len(carried), 0), dtype=np.int64)]
        self.distance = [np.array([])]

    def add(self, distance: np.ndarray, chunk: np.ndarray, block: np.ndarray, x: np.ndarray, q: np.ndarray) -> None:
        k = min(self.k, len(distance))
        bound = self.kth[block]
        near = distance <= bound + SLACK
        # a selection costs far more than a comparison: it is for queries without a bound, or with one that lets many pass
        wide = np.flatnonzero(~np.isfinite(bound) | (np.count_nonzero(near, axis=0) > PASSED * k))
        if len(wide):
            own = distance[:, wide]
            last = np.minimum(np.partition(own, k - 1, axis=0)[k - 1], bound[wide])
            near[:, wide] = (own <= last + SLACK) & np.isfinite(own)
        row, column = np.nonzero(near)
        # the product of a block may round differently from one block shape to the next; equal vectors must tie exactly
        exact = -np.einsum("ij,ij->i", x[row], q[block[column]])
        self.query.append(block[column])
        self.chunk.append(chunk[:, row])
        self.distance.append(exact)

    def settle(self) -> None:
        """Keep the best and note their bounds, once enough was added to those kept before."""
        held, added = len(self.query[0]), sum(len(q) for q in self.query[1:])
        if added > held // 2:
            self.shrink()

    def shrink(self) -> None:
        query, distance = np.concatenate(self.query), np.concatenate(self.distance)
        chunk = np.concatenate(self.chunk, axis=1)
        order = np.lexsort((chunk[0], distance, query))
        query, chunk, distance = query[order], chunk[:, order], distance[order]
        first = np.r_[True, query[1:] != query[:-1]][: len(query)]
        place = np.arange(len(query))
        place = place - np.maximum.accumulate(np.where(first, place, 0)) if len(query) else place
        kept = place < self.k
        last = place == self.k - 1
        self.kth[query[last]] = np.minimum(self.kth[query[last]], distance[last])
        self.query, self.chunk, self.distance = [query[kept]], [chunk[:, kept]], [distance[kept]]

    def batch(self) -> pa.RecordBatch:
        self.shrink()
        columns = [pa.array(self.query_ids[self.query[0]], pa.int64())]
        columns += [pa.array(values, pa.int64()) for values in self.chunk[0]]
        return pa.RecordBatch.from_arrays(
            [*columns, pa.array(self.distance[0], pa.float64())], ["query_id", *self.carried, "distance"]
        )
