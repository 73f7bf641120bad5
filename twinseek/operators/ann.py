"""Approximate semantic search: coarse clusters, a few of them probed per query, exact re-rank inside.

Inner product becomes Euclidean distance by one more coordinate, sqrt(M^2 - |x|^2), where M bounds the norms (Neyshabur and
Srebro, 2015). Clusters are a partition column of the stored vectors, so a probe reads only what it scores.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinseek.operators.vector import Scope, nearest_batch


@dataclass(frozen=True)
class Clusters:
    centers: np.ndarray
    bound: float


def squared_norm(vector: Column) -> Column:
    return F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))


def _augmented(vector: Column, bound: float) -> Column:
    rest = F.sqrt(F.greatest(F.lit(0.0), F.lit(bound * bound) - squared_norm(vector)))
    return F.concat(F.transform(vector, lambda x: x.cast("double")), F.array(rest))


def train(vectors: DataFrame, n_clusters: int, seed: int = 0, max_iterations: int = 10) -> Clusters:
    """Cluster centres of all augmented vectors."""
    known = vectors.filter(F.col("embedding").isNotNull())
    bound = float(known.agg(F.max(F.sqrt(squared_norm(F.col("embedding"))))).first()[0])
    rows = known.select(array_to_vector(_augmented(F.col("embedding"), bound)).alias("features"))
    model = KMeans(k=n_clusters, seed=seed, maxIter=max_iterations).fit(rows)
    return Clusters(np.stack(model.clusterCenters()), bound)


def _closest(clusters: Clusters, probes: int, of_chunks: bool):
    centers = clusters.centers
    half = (centers**2).sum(axis=1) / 2

    @F.pandas_udf("array<int>")
    def closest(vectors: pd.Series) -> pd.Series:
        if len(vectors) == 0:
            return pd.Series([], dtype=object)
        x = np.stack(vectors.to_numpy()).astype(np.float64)
        rest = np.sqrt(np.maximum(0.0, clusters.bound**2 - (x**2).sum(axis=1))) if of_chunks else np.zeros(len(x))
        score = np.c_[x, rest] @ centers.T - half
        order = np.argsort(-score, axis=1, kind="stable")[:, :probes]
        return pd.Series(list(order.astype(np.int32)))

    return closest


def assign(vectors: DataFrame, clusters: Clusters) -> DataFrame:
    """Adds `cluster` to every vector; write the result partitioned by it."""
    known = vectors.filter(F.col("embedding").isNotNull())
    return known.withColumn("cluster", F.element_at(_closest(clusters, 1, True)("embedding"), 1))


def write_clusters(vectors: DataFrame, clusters: Clusters, folder: str) -> None:
    """Store the vectors partitioned by cluster, and the centres beside them."""
    spark = vectors.sparkSession
    assigned = assign(vectors, clusters)
    assigned.hint("rebalance", F.col("cluster")).write.mode("overwrite").partitionBy("cluster").parquet(f"{folder}/vectors")
    rows = [(i, c.tolist(), clusters.bound) for i, c in enumerate(clusters.centers)]
    spark.createDataFrame(rows, "cluster int, center array<double>, bound double").coalesce(1).write.mode("overwrite").parquet(
        f"{folder}/centers"
    )


def read_clusters(spark: SparkSession, folder: str) -> tuple[DataFrame, Clusters]:
    """Stored vectors and their centres. A filter on `cluster` reads only the folders it names."""
    centers = spark.read.parquet(f"{folder}/centers").orderBy("cluster").collect()
    return spark.read.parquet(f"{folder}/vectors"), Clusters(np.array([r["center"] for r in centers]), centers[0]["bound"])


def probed(queries: DataFrame, clusters: Clusters, probes: int) -> DataFrame:
    """One row per query and each of its `probes` best clusters."""
    return (
        queries.filter(F.col("query_embedding").isNotNull())
        .withColumn("probes", _closest(clusters, min(probes, len(clusters.centers)), False)("query_embedding"))
        .withColumn("cluster", F.explode("probes"))
        .drop("probes")
    )


def search(
    queries: DataFrame, assigned: DataFrame, clusters: Clusters, k: int, probes: int, scoped: bool = False
) -> DataFrame:
    """k nearest among the chunks of the `probes` best clusters of each query: `query_id, id, distance, rank`."""
    probe = probed(queries, clusters, probes)
    scopes = [Scope("cluster", "cluster")] + ([Scope("user_id", "user_id")] if scoped else [])
    # a query has one row per probe; clusters share no chunk, so its lists merge by rank alone
    return nearest_batch(probe, assigned, k, scopes)


def recall_sweep(
    queries: DataFrame, assigned: DataFrame, clusters: Clusters, exact: DataFrame, k: int, probes: list[int]
) -> DataFrame:
    """`probes, recall`: mean share of the exact k nearest that the approximate search returns, per effort."""
    wanted = exact.groupBy("query_id").agg(F.count("*").alias("n"))
    result = None
    for p in probes:
        hits = (
            search(queries, assigned, clusters, k, p)
            .select("query_id", "id")
            .join(exact.select("query_id", "id"), ["query_id", "id"], "left_semi")
            .groupBy("query_id")
            .agg(F.count("*").alias("hits"))
        )
        row = wanted.join(hits, "query_id", "left").agg(
            F.lit(p).alias("probes"), F.avg(F.coalesce(F.col("hits"), F.lit(0)) / F.col("n")).alias("recall")
        )
        result = row if result is None else result.unionByName(row)
    return result
