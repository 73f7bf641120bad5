"""Hybrid search: a keyword leg and a semantic leg joined by weighted reciprocal ranks."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinseek.functions.json import json_contains
from twinseek.functions.scores import reciprocal_rank, weighted
from twinseek.operators.blockmax import block_topk
from twinseek.operators.keyword import keyword_matches
from twinseek.operators.ranking import top_k_per_query
from twinseek.operators.sizing import BROADCAST_ROWS, fits_broadcast
from twinseek.operators.vector import PUSHED_SCOPES, Scope, nearest_batch

# Result cap, pool size as a multiple of it, and smoothing constant of the hybrid search.
MAX_RESULTS = 30
POOL_FACTOR = 2
RRF_K = 50
# Fixed values of the two-query fusion: pool per leg, smoothing constant, rank given to rows a leg did not return.
TWO_QUERY_POOL = 40
TWO_QUERY_RRF_K = 60
MISSING_RANK = 1000
# Fixed values of the raw-relevance fusion and of the plain fusion: pool per leg, smoothing constant.
RAW_POOL, RAW_RRF_K = 100, 60
# Bounds on the owners of documents that travel to the chunks: rows of two numbers, and bytes of them written as JSON.
OWNER_ROWS, OWNER_BYTES = 2_000_000, 128 << 20
PLAIN_POOL, PLAIN_RRF_K = 40, 50
# Weight settings (text, semantic) of the sweep.
WEIGHT_SETTINGS = {
    "balanced": (1.0, 1.0),
    "text_heavy": (2.0, 1.0),
    "vector_heavy": (1.0, 2.0),
    "text_only": (1.0, 0.0),
    "vector_only": (0.0, 1.0),
}


@dataclass(frozen=True)
class Corpus:
    """The tables a search reads.

    `text` holds `id, user_id, user_document_id, text_search_vector` and the columns filters use; `vectors` holds the same
    with `embedding`; `chunks` holds the payload; `documents` the parents. One wide table may serve as several of them.
    `user_buckets` is the number of tenant partitions when the tables are laid out by `sources.layout`. With `postings` a
    keyword search without chunk filter reads them instead of `text`: the choice for small batches on large corpora. With `blocks`
    besides, it reads the blocks that can hold the best matches.
    """

    chunks: DataFrame
    documents: DataFrame
    text: DataFrame
    vectors: DataFrame
    dictionary: str = "english"
    vocabulary: DataFrame | None = None
    postings: DataFrame | None = None
    blocks: DataFrame | None = None
    user_buckets: int | None = None


def _apply(df: DataFrame, condition: Column | dict | None) -> DataFrame:
    """A missing filter passes everything; a dict means JSON containment in `meta`."""
    if condition is None:
        return df
    return df.filter(json_contains(F.col("meta"), condition) if isinstance(condition, dict) else condition)


def user_bucket(user_id: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(user_id.cast("long")), F.lit(buckets)).cast("int")


@dataclass(frozen=True)
class Batch:
    """What is known of a query table: its number of rows and, when it asks few enough, its tenants and their partitions."""

    n: int
    users: list[int] | None = None
    buckets: list[int] | None = None


def measure(queries: DataFrame, corpus: Corpus, scoped: bool = True) -> Batch:
    """One small job: rows per tenant, of which at most `PUSHED_SCOPES + 1` come to the driver."""
    if not scoped:
        return Batch(queries.count())
    bucket = F.lit(None).cast("int")
    if corpus.user_buckets is not None:
        bucket = user_bucket(F.col("user_id"), corpus.user_buckets)
    counted = queries.groupBy("user_id").agg(F.count("*").alias("n")).select("user_id", "n", bucket.alias("bucket"))
    rows = counted.limit(PUSHED_SCOPES + 1).collect()
    if len(rows) > PUSHED_SCOPES:
        total = counted.agg(F.sum("n").alias("n"), F.collect_set("bucket").alias("buckets")).first()
        return Batch(total["n"], None, total["buckets"] or None)
    known = [r for r in rows if r["user_id"] is not None]
    return Batch(
        sum(r["n"] for r in rows),
        [r["user_id"] for r in known],
        sorted({r["bucket"] for r in known}) if corpus.user_buckets is not None else None,
    )


def tenant_files(df: DataFrame, batch: Batch) -> DataFrame:
    """Only the partitions, and inside them the row groups, of the tenants that ask."""
    if batch.buckets is not None and "user_bucket" in df.columns:
        df = df.filter(F.col("user_bucket").isin(batch.buckets))
    return df if batch.users is None else df.filter(F.col("user_id").isin(batch.users))


def text_pool(
    queries: DataFrame,
    corpus: Corpus,
    pool: int,
    chunk_filter: Column | dict | None = None,
    scoped: bool = True,
    batch: Batch | None = None,
) -> DataFrame:
    """Best `pool` keyword matches per query: `query_id, id, user_document_id, relevance, rank`."""
    batch = batch or measure(queries, corpus, scoped)
    if corpus.blocks is not None and corpus.postings is not None and chunk_filter is None:
        keep = ["user_document_id"]
        return block_topk(queries, corpus.blocks, corpus.postings, pool, corpus.dictionary, scoped, corpus.vocabulary, keep)[0]
    matches = keyword_matches(
        queries,
        _apply(tenant_files(corpus.text, batch), chunk_filter),
        corpus.dictionary,
        scoped,
        corpus.vocabulary,
        keep=["user_document_id"],
        lines=corpus.postings if chunk_filter is None else None,
        best=pool,
    )
    return top_k_per_query(matches, "relevance", pool, descending=True)


def vector_pool(
    queries: DataFrame,
    corpus: Corpus,
    pool: int,
    chunk_filter: Column | dict | None = None,
    scoped: bool = True,
    batch: Batch | None = None,
) -> DataFrame:
    """Nearest `pool` chunks per query: `query_id, id, user_document_id, distance, rank`."""
    batch = batch or measure(queries, corpus, scoped)
    return nearest_batch(
        queries,
        _apply(tenant_files(corpus.vectors, batch), chunk_filter),
        pool,
        scopes=[Scope("user_id", "user_id")] if scoped else [],
        keep=["user_document_id"],
        n_queries=batch.n,
    )


def keep_documents(pool: DataFrame, documents: DataFrame, doc_filter: Column | dict | None, rows: int) -> DataFrame:
    """Drop pool rows whose document fails the filter and close up the ranks.

    The filter comes after the pool limit, so fewer rows may remain. `rows` bounds the pool; a small pool is broadcast to
    the documents, a large one meets them in a shuffle join.
    """
    if doc_filter is None:
        return pool
    passing = _apply(documents, doc_filter).select(F.col("id").alias("user_document_id"))
    side = F.broadcast(pool) if rows <= BROADCAST_ROWS else pool
    left = passing.join(side, "user_document_id", "inner").select(*pool.columns)
    return top_k_per_query(left.withColumnRenamed("rank", "pool_rank"), "pool_rank", 1 << 31).drop("pool_rank")


def fuse(text: DataFrame, vectors: DataFrame) -> DataFrame:
    """Full outer union of both legs on (query, chunk): ranks and raw scores, null where a leg lacks the row.

    Written as union and group, which costs one shuffle of pool rows where a full outer join would sort both sides.
    """
    a = text.select(
        "query_id", "id", F.col("rank").alias("text_rank"), F.lit(None).cast("long").alias("vector_rank"),
        "relevance", F.lit(None).cast("double").alias("distance"),
    )
    b = vectors.select(
        "query_id", "id", F.lit(None).cast("long").alias("text_rank"), F.col("rank").alias("vector_rank"),
        F.lit(None).cast("double").alias("relevance"), "distance",
    )
    return (
        a.unionByName(b)
        .groupBy("query_id", "id")
        .agg(*[F.max(c).alias(c) for c in ["text_rank", "vector_rank", "relevance", "distance"]])
    )


def rrf_scores(
    fused: DataFrame,
    rrf_k: float | Column = RRF_K,
    full_text_weight: float | Column = 1.0,
    semantic_weight: float | Column = 1.0,
    missing_rank: int | None = None,
) -> DataFrame:
    """Adds `k_score`, `v_score` and their sum `score`. A zero weight keeps the row with what is left."""
    k_score = weighted(reciprocal_rank(F.col("text_rank"), rrf_k, missing_rank), full_text_weight)
    v_score = weighted(reciprocal_rank(F.col("vector_rank"), rrf_k, missing_rank), semantic_weight)
    return fused.withColumn("k_score", k_score).withColumn("v_score", v_score).withColumn(
        "score", F.col("k_score") + F.col("v_score")
    )


def hybrid_ids(
    queries: DataFrame,
    corpus: Corpus,
    match_count: int = 10,
    full_text_weight: float = 1.0,
    semantic_weight: float = 1.0,
    rrf_k: int = RRF_K,
    chunk_filter: Column | dict | None = None,
    doc_filter: Column | dict | None = None,
    max_results: int = MAX_RESULTS,
    batch: Batch | None = None,
) -> DataFrame:
    """Ranked chunk ids: `query_id, id, text_rank, vector_rank, k_score, v_score, score, rank`.

    `queries` may carry its own `match_count, rrf_k, full_text_weight, semantic_weight`; the arguments are the defaults.
    A blank text leaves the semantic leg alone, a null embedding the keyword leg.
    """
    own = _parameters(
        queries,
        match_count=match_count,
        rrf_k=rrf_k,
        full_text_weight=full_text_weight,
        semantic_weight=semantic_weight,
    ).withColumn("match_count", F.least(F.col("match_count"), F.lit(max_results)))
    varied = "match_count" in queries.columns
    most = max_results if varied else min(match_count, max_results)
    pool = most * POOL_FACTOR
    batch = batch or measure(queries, corpus)
    n = batch.n
    legs = []
    for make in (text_pool, vector_pool):
        rows = make(queries, corpus, pool, chunk_filter, batch=batch)
        if varied:
            limits = own.select("query_id", (F.col("match_count") * POOL_FACTOR).alias("pool_k"))
            rows = rows.join(_side(limits, n), "query_id").filter(F.col("rank") <= F.col("pool_k")).drop("pool_k")
        legs.append(keep_documents(rows, corpus.documents, doc_filter, n * pool))
    scored = fuse(*legs)
    if set(queries.columns) & {"match_count", "rrf_k", "full_text_weight", "semantic_weight"}:
        parameters = own.select("query_id", "match_count", "rrf_k", "full_text_weight", "semantic_weight")
        scored = rrf_scores(
            scored.join(_side(parameters, n), "query_id"),
            F.col("rrf_k"), F.col("full_text_weight"), F.col("semantic_weight"),
        )
        best = top_k_per_query(scored, "score", most, descending=True).filter(F.col("rank") <= F.col("match_count"))
    else:
        best = top_k_per_query(
            rrf_scores(scored, rrf_k, full_text_weight, semantic_weight), "score", most, descending=True
        )
    return best.select("query_id", "id", "text_rank", "vector_rank", "k_score", "v_score", "score", "rank")


def _side(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


def _parameters(queries: DataFrame, **defaults: float) -> DataFrame:
    for name, value in defaults.items():
        current = F.col(name) if name in queries.columns else F.lit(None)
        queries = queries.withColumn(name, F.coalesce(current, F.lit(value)))
    return queries


def with_payload(
    ranked: DataFrame,
    queries: DataFrame,
    corpus: Corpus,
    rows_per_query: int,
    scoped: bool = True,
    batch: Batch | None = None,
) -> DataFrame:
    """Late join of ranked ids to the chunk columns. The tenant is part of the join, so only its files are read."""
    batch = batch or measure(queries, corpus, scoped)
    n = batch.n
    on = ["id"]
    if scoped:
        ranked = ranked.join(_side(queries.select("query_id", "user_id"), n), "query_id")
        on.append("user_id")
        if corpus.user_buckets is not None and "user_bucket" in corpus.chunks.columns:
            ranked = ranked.withColumn("user_bucket", user_bucket(F.col("user_id"), corpus.user_buckets))
            on.append("user_bucket")
    side = F.broadcast(ranked) if n * rows_per_query <= BROADCAST_ROWS else ranked
    return tenant_files(corpus.chunks, batch).join(side, on)


def hybrid_search(queries: DataFrame, corpus: Corpus, **parameters) -> DataFrame:
    """The hybrid search with chunk payload: `query_id, rank, id, user_document_id, paragraph_id, text, meta, created_at,
    k_score, v_score, score`."""
    batch = measure(queries, corpus)
    ranked = hybrid_ids(queries, corpus, batch=batch, **parameters)
    most = parameters.get("max_results", MAX_RESULTS)
    return with_payload(ranked, queries, corpus, most, batch=batch).select(
        "query_id", "rank", "id", "user_document_id", "paragraph_id", "text", "meta", "created_at",
        "k_score", "v_score", "score",
    )


def _fused_pools(queries: DataFrame, corpus: Corpus, pool: int, scoped: bool = True) -> DataFrame:
    batch = measure(queries, corpus, scoped)
    return fuse(
        text_pool(queries, corpus, pool, scoped=scoped, batch=batch),
        vector_pool(queries, corpus, pool, scoped=scoped, batch=batch),
    )


def hybrid_two_query(queries: DataFrame, corpus: Corpus, limit: int = 10) -> DataFrame:
    """Both legs at a fixed pool, a missing rank counting as a very high one."""
    fused = _fused_pools(queries, corpus, TWO_QUERY_POOL)
    scored = rrf_scores(fused, TWO_QUERY_RRF_K, missing_rank=MISSING_RANK)
    return top_k_per_query(scored, "score", limit, descending=True).select(
        "query_id", F.col("id").alias("chunk_id"), "vector_rank", "text_rank", F.col("score").alias("rrf_score"), "rank"
    )


def hybrid_raw(
    queries: DataFrame, corpus: Corpus, vector_weight: float = 1.0, text_weight: float = 1.0, limit: int = 10
) -> DataFrame:
    """Weighted fusion that reports the raw relevance and the unweighted semantic part."""
    fused = _fused_pools(queries, corpus, RAW_POOL)
    semantic = F.coalesce(reciprocal_rank(F.col("vector_rank"), RAW_RRF_K), F.lit(0.0))
    keyword = F.coalesce(reciprocal_rank(F.col("text_rank"), RAW_RRF_K), F.lit(0.0))
    scored = fused.select(
        "query_id",
        "id",
        F.coalesce("relevance", F.lit(0.0)).alias("k_score"),
        semantic.alias("v_score"),
        (semantic * F.lit(float(vector_weight)) + keyword * F.lit(float(text_weight))).alias("score"),
    )
    return top_k_per_query(scored, "score", limit, descending=True)


def hybrid_plain(queries: DataFrame, corpus: Corpus, limit: int = 10, scope: str = "user") -> DataFrame:
    """Unweighted fusion of fixed pools, ids only. `scope`: `none`, `user` (on the chunk) or `join` (on its document)."""
    if scope not in ("none", "user", "join"):
        raise ValueError(f"unknown scope {scope!r}")
    if scope == "join":
        corpus = replace(
            corpus,
            text=owned(corpus.text, corpus.documents),
            vectors=owned(corpus.vectors, corpus.documents),
            postings=None,
            blocks=None,
            user_buckets=None,
        )
    scoped = scope != "none"
    fused = _fused_pools(queries, corpus, PLAIN_POOL, scoped)
    return top_k_per_query(rrf_scores(fused, PLAIN_RRF_K), "score", limit, descending=True).select(
        "query_id", "id", "score", "rank"
    )


def owned(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunks with their document's owner in place of their own: the normalised schema. Orphans drop out.

    Owners of measured size travel to the chunks, whose text vectors are several times their text; more of them meet by shuffle.
    """
    owners = documents.select(F.col("id").alias("user_document_id"), "user_id")
    side = F.broadcast(owners) if fits_broadcast(owners, OWNER_ROWS, OWNER_BYTES) else owners
    return chunks.drop("user_id").join(side, "user_document_id")


def weight_sweep(queries: DataFrame, corpus: Corpus, match_count: int = 10, settings: dict | None = None) -> DataFrame:
    """The hybrid search under several weights. Legs are ranked once; only the scoring repeats."""
    settings = settings or WEIGHT_SETTINGS
    k = min(match_count, MAX_RESULTS)
    pool = k * POOL_FACTOR
    fused = _fused_pools(queries, corpus, pool)
    variants = F.array(
        *[
            F.struct(F.lit(name).alias("name"), F.lit(float(t)).alias("t"), F.lit(float(s)).alias("s"))
            for name, (t, s) in settings.items()
        ]
    )
    spread = fused.withColumn("w", F.explode(variants)).withColumn("weights", F.col("w.name"))
    scored = rrf_scores(spread, RRF_K, F.col("w.t"), F.col("w.s"))
    return top_k_per_query(scored, "score", k, by=["weights", "query_id"], descending=True).select(
        "weights", "query_id", "id", "k_score", "v_score", "score", "rank"
    )
