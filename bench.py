"""Headline numbers: ingestion once, then batches of searches over the stored tables.

Prints one JSON line. Times are seconds for a whole batch; `per_query_ms` divides by the number of queries.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from pyspark.sql import functions as F  # noqa: E402

from twinseek.operators import fusion, metrics, vector  # noqa: E402
from twinseek.plans import suite  # noqa: E402
from twinseek.session import local_session  # noqa: E402
from twinseek.sources import corpus as cp  # noqa: E402
from twinseek.sources import layout  # noqa: E402

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
BUCKETS = 8


def run(df) -> None:
    """Execute completely without bringing rows to the driver."""
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = local_session(CPUS, os.environ.get("BENCH_MEMORY", "12g"), int(CPUS))
    place = tempfile.mkdtemp(prefix="twinseek-bench-")
    seconds: dict[str, float] = {}

    def clock(name: str, work) -> None:
        start = time.perf_counter()
        work()
        seconds[name] = round(time.perf_counter() - start, 3)

    # a corpus is stored in many files; the given tables are single ones, which one core would read alone
    for name in ("documents", "embeddings", "labels"):
        cp.table(spark, FOLDER, name).repartition(int(CPUS)).write.parquet(f"{place}/tables/{name}.parquet")
    documents, chunks = cp.documents(spark, f"{place}/tables"), cp.chunks(spark, f"{place}/tables")
    clock("ingest", lambda: layout.write_corpus(documents, chunks, f"{place}/corpus", "english", BUCKETS))
    tables = layout.read_corpus(spark, f"{place}/corpus")
    cp.known_item_queries(spark, f"{place}/tables").write.parquet(f"{place}/queries")
    everything = spark.read.parquet(f"{place}/queries")
    n_all = everything.count()
    batches = {}
    for n in (1, 50, min(1000, n_all)):
        everything.orderBy(F.xxhash64("query_id"), "query_id").limit(n).write.parquet(f"{place}/queries_{n}")
        batches[n] = spark.read.parquet(f"{place}/queries_{n}")

    searches = {
        "semantic_user": lambda q: fusion.vector_pool(q, tables, 10),
        "semantic_all": lambda q: fusion.vector_pool(q, tables, 10, scoped=False),
        "semantic_user_json": lambda q: suite.simple_json_search(q, tables.vectors),
        "keyword_user": lambda q: fusion.text_pool(q, tables, 10),
        "keyword_all": lambda q: fusion.text_pool(q, tables, 10, scoped=False),
        "hybrid_user": lambda q: fusion.hybrid_search(q, tables),
    }
    # let the JVM compile before anything is measured
    for _ in range(2):
        for search in searches.values():
            run(search(batches[50]))
    per_query = {}
    for name, search in searches.items():
        for n, queries in batches.items():
            clock(f"{name}_{n}", lambda: run(search(queries)))
            per_query[f"{name}_{n}"] = round(seconds[f"{name}_{n}"] / n * 1000, 3)
    pool = vector.nearest(tables.vectors, batches[1].first()["query_embedding"], 10)
    clock("semantic_one_jvm", lambda: run(pool))

    known = batches[max(batches)]
    quality = {}
    for name in ("semantic_user", "keyword_user", "hybrid_user"):
        ranks = metrics.ground_truth_ranks(known, searches[name](known).select("query_id", "id", "rank"))
        row = ranks.agg(
            metrics.recall(F.col("ground_truth_rank")).alias("found"),
            metrics.recall_at(F.col("ground_truth_rank"), 1).alias("rank_1"),
            metrics.mrr(F.col("ground_truth_rank")).alias("mrr"),
        ).first()
        quality[name] = {k: round(v, 4) for k, v in row.asDict().items()}

    print(
        json.dumps(
            {
                "metric": "total seconds of ingestion and search batches",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "per_query_ms": per_query,
                "quality": quality,
                "chunks": tables.chunks.count(),
                "sf": os.path.basename(FOLDER.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
