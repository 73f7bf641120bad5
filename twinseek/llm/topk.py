"""Exact top-k by inner product with the threshold algorithm over sorted per-dimension lists.

Rows are dealt into shards and queries into blocks of bounded size; each pair of them is one group of the job, so neither
side has to fit a task or the driver. In a shard every dimension has its rows sorted by value. The queries of a block read the lists from
both ends, downwards for positive and upwards for negative components, all to the same depth; rows that come up are scored in full, in
one product for all queries that are not finished. No row that has not come up can score more than the sum over the dimensions of
query component times the value at the present depth. Once this bound is below a query's k-th best score (equal scores could still
win by id), the query is finished in that shard. The best of all
shards are ranked at the end; a query never has more than k rows per shard.

Components are whole numbers, floor(1024 x), so scores are exact.

Defined cases: vectors that are null or hold null or non-finite components take no part; only vectors of equal length meet;
repeated ids are separate rows and a repeated query has a list per row; null ids are candidates and lose ties; scores beyond 64
bits become the largest or smallest number of 64 bits; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from twinseek.llm.common import stored

SCALE = 1024
SHARD_ROWS, BLOCK_QUERIES = 4096, 1024
# Depth of the first reading of the lists; each further one goes GROWTH times as deep.
FIRST_DEPTH, GROWTH = 16, 4
# Below every score.
NEVER = float("-inf")
FOUND = "query_row long, query_id long, vec_id long, row long, score long"


def whole_numbers(vectors: Column) -> Column:
    """floor(1024 x) of every component; null where the vector takes no part."""
    finite = F.forall(vectors, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    scaled = F.transform(vectors, lambda x: F.floor(F.lit(SCALE) * x.cast("double")).cast("long"))
    return F.when(finite, scaled)


def matrix(column: pa.ChunkedArray, rows: int) -> np.ndarray:
    """Vectors of equal length as a matrix: floats where these hold all sums exactly, else integers of any size."""
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    whole = flat.reshape(rows, -1)
    reach = max((abs(int(whole.min())), abs(int(whole.max()))) if whole.size else (0,))
    return whole.astype(np.float64) if reach * reach * max(whole.shape[1], 1) < 1 << 53 else whole.astype(object)


class SortedLists:
    """One shard: its vectors, for each dimension its values in order, and the depth at which each row first comes up."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        n = len(vectors)
        order = np.argsort(vectors, axis=0, kind="stable")
        self.values = np.take_along_axis(vectors, order, axis=0) if vectors.size else vectors
        place = np.empty(vectors.shape, np.int64)
        if vectors.size:
            np.put_along_axis(place, order, np.arange(n)[:, None], axis=0)
        # lists are read from both ends, as queries of a block have either sign
        first = np.minimum(place, n - 1 - place).min(axis=1, initial=n)
        self.rows = np.argsort(first, kind="stable")
        self.first = first[self.rows]

    def bounds(self, queries: np.ndarray, depth: int) -> np.ndarray:
        """What a row that has not come up at a depth can score at most, for each query."""
        high, low = self.values[len(self.values) - depth], self.values[depth - 1]
        return np.maximum(queries, 0) @ high + np.minimum(queries, 0) @ low

    def best(self, queries: np.ndarray, k: int, own: np.ndarray, by_id: np.ndarray) -> tuple[list[tuple], int]:
        """(query, row, score) of the k best rows besides `own` of every query, equal scores by `by_id`; and how many rows were scored.

        All queries that are not finished read the lists to the same depth; the rows that come up fresh are scored in one product.
        """
        n = len(self.vectors)
        found: list[tuple] = []
        open_ = np.arange(len(queries))
        scores = np.zeros((len(queries), 0), queries.dtype)
        place_of = np.empty(n, np.int64)
        place_of[self.rows] = np.arange(n)
        depth, scored = FIRST_DEPTH, 0
        while len(open_):
            # with no component at all, all rows tie at 0
            end = n if depth >= n or not queries.shape[1] else int(np.searchsorted(self.first, depth))
            fresh = queries[open_] @ self.vectors[self.rows[scored:end]].T
            mine = np.where(own[open_] >= 0, place_of[own[open_]], -1)
            for i in np.flatnonzero((mine >= scored) & (mine < end)):
                fresh[i, mine[i] - scored] = NEVER if fresh.dtype == object else -np.inf
            scores = np.concatenate([scores, fresh], axis=1)
            scored = end
            if end > k:
                kth = np.partition(scores, -k, axis=1)[:, -k]
                done = np.full(len(open_), True) if end == n else kth > self.bounds(queries[open_], depth)
            else:
                kth = np.full(len(open_), -np.inf)
                done = np.full(len(open_), end == n)
            for i in np.flatnonzero(done):
                of = scores[i]
                above, equal = np.flatnonzero(of > kth[i]), np.flatnonzero(of == kth[i])
                equal = equal[np.argsort(by_id[self.rows[equal]], kind="stable")][: max(0, k - len(above))]
                kept = [j for j in (*above, *equal) if of[j] > NEVER]
                found += [(int(open_[i]), int(self.rows[j]), int(of[j])) for j in kept]
            open_, scores = open_[~done], scores[~done]
            depth *= GROWTH
        return found, scored


def _search(k: int):
    limit = (1 << 63) - 1

    def search(key: tuple, queries: pa.Table, shard: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if queries.num_rows and shard.num_rows:
            vectors = matrix(shard.column("vector"), shard.num_rows)
            asked = matrix(queries.column("vector"), queries.num_rows)
            if asked.dtype != vectors.dtype or asked.dtype == object:
                vectors, asked = (m.astype(np.int64).astype(object) for m in (vectors, asked))
            ids = shard.column("vec_id").to_pylist()
            places = shard.column("row").to_pylist()
            at = {row: i for i, row in enumerate(places)}
            heads = list(zip(queries.column("row").to_pylist(), queries.column("vec_id").to_pylist(), strict=True))
            by_id = np.empty(len(ids), np.int64)
            by_id[sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, places[i]))] = np.arange(len(ids))
            own = np.array([at.get(row, -1) for row, _ in heads])
            for query, row, score in SortedLists(vectors).best(asked, k, own, by_id)[0]:
                out.append((*heads[query], ids[row], places[row], max(min(score, limit), -limit - 1)))
        columns = list(zip(*out, strict=True)) or [()] * 5
        names = ["query_row", "query_id", "vec_id", "row", "score"]
        return pa.table([pa.array(c, pa.int64()) for c in columns], names)

    return search


def top_k(vectors: DataFrame, queries: Column, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: the k best other rows of (vec_id, embedding) for every row that `queries` holds for."""
    numbered = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        whole_numbers(F.col("embedding")).alias("vector"),
        F.coalesce(queries, F.lit(False)).alias("asks"),
    ).filter(F.col("vector").isNotNull())
    rows = stored(
        numbered.withColumn("row", F.monotonically_increasing_id()).withColumn("length", F.size("vector")), "vectors"
    )
    sizes = rows.agg(F.count("*").alias("n"), F.count_if("asks").alias("q")).first()
    shards = max(1, -(-sizes["n"] // SHARD_ROWS))
    blocks = max(1, -(-sizes["q"] // BLOCK_QUERIES))

    def dealt(own: str, n: int, other: str, m: int, table: DataFrame) -> DataFrame:
        return table.select(
            "length",
            F.pmod(F.xxhash64("row", F.lit(own)), F.lit(n)).cast("int").alias(own),
            F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias(other),
            "row",
            "vec_id",
            "vector",
        )

    keys = ["length", "block", "shard"]
    asking = dealt("block", blocks, "shard", shards, rows.filter("asks")).groupBy(*keys)
    held = dealt("shard", shards, "block", blocks, rows).groupBy(*keys)
    found = asking.cogroup(held).applyInArrow(_search(k), FOUND)
    best = Window.partitionBy("query_row", "query_id").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "row")
    return (
        found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    )
