"""Approximate semantic search over product-quantised residuals, with an exact re-rank of a pool.

A vector lies in a coarse cluster (`ann`); what is left of it after the cluster's centre is cut into parts, and each part is named by the
nearest of 256 centres of its place: one byte a part. A query scores a code by one table lookup a part. Codes of the probed
clusters meet the queries by shuffle, in shards and blocks of bounded size; the best `pool` codes of a query fetch their vectors
and are ranked by them.

The centres are fitted on at most FIT_ROWS vectors, drawn by hash; every vector gets a code.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinseek.functions.vectors import negative_inner_product
from twinseek.operators.ann import Clusters, assign, probed, read_clusters, write_clusters
from twinseek.operators.ranking import top_k_per_query
from twinseek.operators.vector import SCORE_BLOCK, SHARD_BATCH, TopRows
from twinseek.session import cut_lineage

CENTERS, PARTS, ROUNDS = 256, 16, 12
# Vectors that the centres are fitted on at most; codes of a shard, and queries of a block, that meet in one group.
FIT_ROWS, SHARD_CODES, BLOCK_QUERIES = 65_536, 1 << 18, 4096
SCORED = 1 << 14
# Rows that a group hands on at once; with a large pool fewer queries make a block.
FOUND_ROWS = 1 << 21
# Codes and queries that meet in one group, with the vectors, where the pool holds every code.
WHOLE_CODES, WHOLE_QUERIES = 1 << 16, 1 << 14
FOUND = "query_id long, id long, cluster int, about double"


@dataclass(frozen=True)
class Codebook:
    """Centres of every part: (parts, centres, width). The last part is filled up with zeros."""

    centers: np.ndarray

    @property
    def parts(self) -> int:
        return self.centers.shape[0]

    def cut(self, vectors: np.ndarray) -> np.ndarray:
        """Vectors as (rows, parts, width)."""
        parts, _, width = self.centers.shape
        whole = np.zeros((len(vectors), parts * width))
        whole[:, : vectors.shape[1]] = vectors
        return whole.reshape(len(vectors), parts, width)

    def codes(self, residuals: np.ndarray) -> np.ndarray:
        """Number of the nearest centre of every part."""
        cut = self.cut(residuals)
        out = np.empty(cut.shape[:2], np.uint8)
        for part, centers in enumerate(self.centers):
            out[:, part] = nearest_center(cut[:, part], centers)
        return out

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """Inner product of each query's parts with all centres: (queries, parts, centres)."""
        return np.einsum("qpw,pcw->qpc", self.cut(queries), self.centers)


def nearest_center(rows: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return np.argmax(rows @ centers.T - (centers**2).sum(axis=1) / 2, axis=1)


def fitted_centers(rows: np.ndarray, n: int, rounds: int = ROUNDS, seed: int = 0) -> np.ndarray:
    """Centres by rounds of nearest assignment and means; a centre that loses all rows moves to the row that fits worst."""
    random = np.random.default_rng(seed)
    centers = rows[random.permutation(len(rows))[:n]]
    centers = np.concatenate([centers, np.repeat(centers[:1], n - len(centers), axis=0)])
    for _ in range(rounds):
        nearest = nearest_center(rows, centers)
        counts = np.bincount(nearest, minlength=n)
        sums = np.zeros_like(centers)
        np.add.at(sums, nearest, rows)
        centers = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centers)
        lost = np.flatnonzero(counts == 0)
        if len(lost):
            worst = np.argsort(-((rows - centers[nearest]) ** 2).sum(axis=1), kind="stable")[: len(lost)]
            centers[lost[: len(worst)]] = rows[worst]
    return centers


def _stacked(lists: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)


def _residuals(vectors: np.ndarray, clusters: np.ndarray, coarse: Clusters) -> np.ndarray:
    # the last coordinate of a coarse centre belongs to its norm, not to the vector
    return vectors - coarse.centers[clusters][:, :-1]


def train(assigned: DataFrame, coarse: Clusters, parts: int = PARTS, sample: int = FIT_ROWS, seed: int = 0) -> Codebook:
    """Centres for (id, embedding, cluster); each part is fitted by a task of its own."""
    drawn = assigned.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(sample).select("embedding", "cluster")
    width = -(-(coarse.centers.shape[1] - 1) // parts)
    empty = Codebook(np.zeros((parts, 1, width)))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                pieces = empty.cut(_residuals(_stacked(batch["embedding"]), batch["cluster"].to_numpy(), coarse))
                for part in range(parts):
                    rows = pa.FixedSizeListArray.from_arrays(pa.array(pieces[:, part].ravel()), width)
                    number = pa.array(np.full(batch.num_rows, part), pa.int32())
                    yield pa.RecordBatch.from_arrays([number, rows.cast(pa.list_(pa.float64()))], ["part", "piece"])

    def fit(table: pa.Table) -> pa.Table:
        rows = _stacked(table["piece"])
        # tasks deliver rows in any order; the centres must not depend on it
        centers = fitted_centers(rows[np.lexsort(rows.T)], CENTERS, seed=seed)
        return pa.table({"part": table["part"].slice(0, 1), "centers": pa.array([centers.ravel().tolist()])})

    fitted = drawn.mapInArrow(cut, "part int, piece array<double>").groupBy("part").applyInArrow(fit, "part int, centers array<double>")
    rows = {r["part"]: r["centers"] for r in fitted.collect()}
    if not rows:
        return Codebook(np.zeros((parts, CENTERS, width)))
    return Codebook(np.array([rows[p] for p in range(parts)]).reshape(parts, CENTERS, width))


def with_codes(assigned: DataFrame, coarse: Clusters, book: Codebook) -> DataFrame:
    """Adds `code`, one byte a part, to (…, embedding, cluster)."""

    def coded(vectors: pa.Array, clusters: pa.Array) -> pa.Array:
        if not len(vectors):
            return pa.array([], pa.binary())
        codes = book.codes(_residuals(_stacked(vectors), clusters.to_numpy(), coarse))
        return pa.FixedSizeBinaryArray.from_buffers(
            pa.binary(book.parts), len(codes), [None, pa.py_buffer(codes.tobytes())]
        ).cast(pa.binary())

    return assigned.withColumn("code", F.arrow_udf(coded, "binary")("embedding", "cluster"))


def write_codes(vectors: DataFrame, coarse: Clusters, folder: str, parts: int = PARTS) -> None:
    """Vectors and codes, both by cluster, coarse centres and the codebook. `vectors` has `id`, `embedding` and what else is kept."""
    write_clusters(vectors, coarse, folder)
    assigned, _ = read_clusters(vectors.sparkSession, folder)
    book = train(assigned, coarse, parts)
    coded = with_codes(assigned, coarse, book).select("id", "code", "cluster")
    coded.write.mode("overwrite").partitionBy("cluster").parquet(f"{folder}/codes")
    rows = [(i, c.ravel().tolist()) for i, c in enumerate(book.centers)]
    spark = vectors.sparkSession
    spark.createDataFrame(rows, "part int, centers array<double>").coalesce(1).write.mode("overwrite").parquet(f"{folder}/book")


@dataclass(frozen=True)
class Coded:
    """A stored approximate index."""

    vectors: DataFrame
    codes: DataFrame
    coarse: Clusters
    book: Codebook


def read_codes(spark: SparkSession, folder: str) -> Coded:
    assigned, coarse = read_clusters(spark, folder)
    rows = spark.read.parquet(f"{folder}/book").orderBy("part").collect()
    book = Codebook(np.array([r["centers"] for r in rows]).reshape(len(rows), CENTERS, -1))
    return Coded(assigned, spark.read.parquet(f"{folder}/codes"), coarse, book)


def _lookup(pool: int, coarse: Clusters, book: Codebook) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    """The best `pool` codes of one shard of one cluster for every query of a block."""

    def search(key: tuple, asking: pa.Table, codes: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]]
        if asking.num_rows and codes.num_rows:
            queries = _stacked(asking["query_embedding"])
            own, ids = asking["query_id"].to_numpy(), codes["id"].to_numpy()
            order = np.argsort(ids, kind="stable")
            ids = ids[order]
            names = np.frombuffer(b"".join(codes["code"].to_pylist()), np.uint8).reshape(len(ids), book.parts)[order]
            cluster = key[0].as_py()
            base = queries @ coarse.centers[cluster][:-1]
            for at, table in enumerate(book.tables(queries)):
                scores = np.full(len(ids), base[at])
                for part in range(book.parts):
                    scores += table[part][names[:, part]]
                if len(ids) > pool:
                    last = np.partition(scores, -pool)[-pool]
                    above, equal = np.flatnonzero(scores > last), np.flatnonzero(scores == last)
                    best = np.concatenate([above, equal[: pool - len(above)]])
                else:
                    best = np.arange(len(ids))
                out.append([np.full(len(best), own[at]), ids[best], scores[best]])
        query, id_, score = (np.concatenate(x) for x in zip(*out, strict=True))
        cluster = np.full(len(query), key[0].as_py() or 0, np.int32)
        return pa.table([pa.array(query), pa.array(id_), pa.array(cluster), pa.array(-score)], ["query_id", "id", "cluster", "about"])

    return search


def _reranked(k: int, pool: int, coarse: Clusters, book: Codebook) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    """The k nearest of one shard of one cluster for every query of a block, among the pool that its codes make."""

    def search(key: tuple, asking: pa.Table, codes: pa.Table) -> pa.Table:
        if not asking.num_rows or not codes.num_rows:
            return pa.Table.from_batches([TopRows(np.zeros(0, np.int64), k, ["id"]).batch()])
        queries, x = _stacked(asking["query_embedding"]), _stacked(codes["embedding"])
        ids = codes["id"].to_numpy()
        names = np.frombuffer(b"".join(codes["code"].to_pylist()), np.uint8).reshape(len(ids), book.parts).T.astype(np.int64)
        base = queries @ coarse.centers[key[0].as_py()][:-1]
        best = TopRows(asking["query_id"].to_numpy(), k, ["id"])
        for start in range(0, len(queries), SCORE_BLOCK):
            block = np.arange(start, min(start + SCORE_BLOCK, len(queries)))
            pooled = np.ones((len(ids), len(block)), bool)
            for at, table in enumerate(book.tables(queries[block])):
                scores = np.full(len(ids), base[block[at]])
                for part in range(book.parts):
                    scores += table[part].take(names[part])
                if len(ids) > pool:
                    pooled[:, at] = scores >= np.partition(scores, -pool)[-pool]
            for low in range(0, len(ids), SHARD_BATCH):
                some = slice(low, low + SHARD_BATCH)
                distance = np.where(pooled[some], -(x[some] @ queries[block].T), np.inf)
                best.add(distance, ids[None, some], block, x[some], queries)
            best.settle()
        return pa.Table.from_batches([best.batch()])

    return search


def _search_whole(asked: DataFrame, index: Coded, counts: dict[int, int], k: int, pool: int) -> DataFrame:
    """Searches whose pool holds every code of the probed clusters: nothing is left to choose between groups, so each of them ranks its
    codes by their vectors and hands on k rows a query: `query_id, id, distance`."""
    n = asked.select("query_id").distinct().count()
    sizes = [max(1, -(-counts.get(c, 0) // WHOLE_CODES)) for c in range(len(index.coarse.centers))]
    blocks = max(1, -(-n // WHOLE_QUERIES))
    shards = F.get(F.array(*[F.lit(s) for s in sizes]), F.col("cluster"))
    keys = ["cluster", "shard", "block"]
    left = asked.select(
        "query_id", "query_embedding", "cluster", _class("query_id", F.lit(blocks)).alias("block"),
        F.explode(F.sequence(F.lit(0), shards - 1)).alias("shard"),
    )
    rows = index.codes.select("id", "code", "cluster").join(index.vectors.select("id", "cluster", "embedding"), ["cluster", "id"])
    right = rows.select("*", _class("id", shards).alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    right = right.join(F.broadcast(asked.select("cluster").distinct()), "cluster", "left_semi")
    meet = _reranked(k, pool, index.coarse, index.book)
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, "query_id long, id long, distance double")


def search(queries: DataFrame, index: Coded, k: int, probes: int, pool: int) -> DataFrame:
    """k nearest by exact distance among the `pool` best codes of each query's `probes` clusters: `query_id, id, distance, rank`.

    Where the pool holds all codes of a query's clusters, the vectors meet the queries beside the codes and no pair leaves its group.
    """
    asked = cut_lineage(probed(queries.select("query_id", "query_embedding"), index.coarse, probes))
    # one row a cluster: how many shards its codes are dealt into
    counts = {r["cluster"]: r["count"] for r in index.codes.groupBy("cluster").count().collect()}
    held = F.get(F.array(*[F.lit(counts.get(c, 0)).cast("long") for c in range(len(index.coarse.centers))]), F.col("cluster"))
    sums = cut_lineage(asked.groupBy("query_id").agg(F.sum(held).alias("codes")))
    few = sums.agg(F.count_if(F.col("codes") <= pool).alias("whole"), F.count_if(F.col("codes") > pool).alias("cut")).first()
    if few["whole"]:
        whole = asked.join(sums.filter(F.col("codes") <= pool), "query_id", "left_semi")
        found = _search_whole(whole, index, counts, k, pool)
        if few["cut"]:
            cut = asked.join(sums.filter(F.col("codes") > pool), "query_id", "left_semi")
            found = found.unionByName(_search_pool(queries, cut_lineage(cut), index, counts, pool))
    else:
        found = _search_pool(queries, asked, index, counts, pool)
    return top_k_per_query(found, "distance", k)


def _search_pool(queries: DataFrame, asked: DataFrame, index: Coded, counts: dict[int, int], pool: int) -> DataFrame:
    """Distances of the `pool` best codes of each query: `query_id, id, distance`."""
    n = asked.select("query_id").distinct().count()
    sizes = [max(1, -(-counts.get(c, 0) // SHARD_CODES)) for c in range(len(index.coarse.centers))]
    handed_on = min(pool, max([-(-m // sizes[c]) for c, m in counts.items()], default=1))
    blocks = max(1, -(-n // max(1, min(BLOCK_QUERIES, FOUND_ROWS // max(1, handed_on)))))
    shards = F.get(F.array(*[F.lit(s) for s in sizes]), F.col("cluster"))
    keys = ["cluster", "shard", "block"]
    left = asked.select(
        "query_id", "query_embedding", "cluster", _class("query_id", F.lit(blocks)).alias("block"),
        F.explode(F.sequence(F.lit(0), shards - 1)).alias("shard"),
    )
    right = index.codes.select(
        "id", "code", "cluster", _class("id", shards).alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    )
    # codes of clusters that nobody asks are not read
    right = right.join(asked.select("cluster").distinct(), "cluster", "left_semi")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_lookup(pool, index.coarse, index.book), FOUND)
    best = top_k_per_query(found, "about", pool).drop("about", "rank")
    ranked = best.join(index.vectors.select("id", "cluster", "embedding"), ["cluster", "id"]).join(
        queries.select("query_id", "query_embedding"), "query_id"
    )
    exact = negative_inner_product(F.col("embedding"), F.col("query_embedding")).alias("distance")
    return ranked.select("query_id", "id", exact)


def _class(column: str, n: Column) -> Column:
    return F.pmod(F.xxhash64(column), n).cast("int")
