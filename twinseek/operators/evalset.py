"""Building evaluation sets: repeatable samples, known items, generated queries tied to their documents."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinseek.functions import text as tx
from twinseek.functions.json import json_text
from twinseek.operators import histograms

from twinseek.operators.ranking import blocked_row_number, hash_order
from twinseek.operators.sizing import BROADCAST_ROWS

# Share and surplus of the block sample, text length a chunk must exceed, batch and queries per document.
SAMPLE_SHARE = 0.02
SAMPLE_SURPLUS = 3
MIN_TEXT = 300
GENERATION_BATCH = 10
# A share is drawn in steps of one millionth, by hash of the id, so it does not depend on how rows are partitioned.
SHARE_STEPS = 1_000_000
QUERIES_PER_DOCUMENT = 2
# Queries are numbered in blocks of this many generation batches.
BATCH_BLOCK = 10_000


def random_key(column: str, seed: int = 0) -> Column:
    """A repeatable random sort key, which other engines can repeat too."""
    return F.md5(F.concat(F.col(column).cast("string"), F.lit(f":{seed}")))


def random_rows(df: DataFrame, n: int, key: str = "id", seed: int = 0) -> DataFrame:
    return df.orderBy(random_key(key, seed), key).limit(n)


def known_items(chunks: DataFrame, n: int, seed: int = 0, share: float | None = SAMPLE_SHARE) -> DataFrame:
    """n sampled chunks as queries, each its own expected answer.

    A share of the rows is drawn, then three times n of them, then n with metadata; `share=None` skips the first draw.
    """
    drawn = chunks
    if share is not None:
        number = F.conv(F.substring(random_key("id", seed + 2), 1, 8), 16, 10).cast("long")
        drawn = chunks.filter(number % SHARE_STEPS < int(share * SHARE_STEPS))
    few = random_rows(drawn, SAMPLE_SURPLUS * n, seed=seed)
    chosen = random_rows(few.filter(F.col("meta").isNotNull()), n, seed=seed + 1)
    return as_known_items(chosen)


def as_known_items(chunks: DataFrame) -> DataFrame:
    return chunks.select(
        "id", "user_id", "embedding", tx.keyword_query_text(F.col("text")).alias("search_text"), "meta", "user_document_id"
    )


def pick_json_filter(chunks: DataFrame, seed: int = 0) -> dict | None:
    """A frequent metadata key and one of its frequent values, drawn repeatably. None when nothing is frequent enough.

    The histograms run distributed; at most ten rows of each reach the driver. The value keeps its JSON type.
    """
    keys = [r["key"] for r in histograms.key_histogram(chunks).collect()][: histograms.KEY_CHOICES]
    if not keys:
        return None
    key = keys[seed % len(keys)]
    values = histograms.frequent_values(histograms.value_histogram(chunks, key)).collect()
    if not values:
        return None
    val = values[seed % len(values)]["val"]
    typed = (
        chunks.filter(json_text(F.col("meta"), key) == val)
        .select(F.to_json(F.struct(F.try_variant_get(F.try_parse_json("meta"), f"$['{key}']", "variant").alias("v"))).alias("j"))
        .first()
    )
    return {key: json.loads(typed["j"])["v"]}


def one_chunk_per_document(documents: DataFrame, chunks: DataFrame, seed: int = 0, key: Column | None = None) -> DataFrame:
    """`user_document_id, id`: one random chunk of more than 300 characters per document (`key` replaces the random order).

    A partial aggregate over ids alone; text and vectors are fetched for the chosen afterwards.
    """
    key = random_key("id", seed) if key is None else key
    long = chunks.filter(F.length("text") > MIN_TEXT)
    one = long.groupBy("user_document_id").agg(F.min_by("id", F.struct(key, "id")).alias("id"))
    return one.join(documents.select(F.col("id").alias("user_document_id")), "user_document_id", "left_semi")


def with_chunks(picked: DataFrame, documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Document and chunk columns of picked pairs."""
    rows = chunks.join(picked, ["id", "user_document_id"]).select(
        F.col("user_document_id").alias("document_id"),
        F.col("id").alias("chunk_id"),
        "paragraph_id",
        F.col("text").alias("chunk_text"),
        "embedding",
        "meta",
    )
    titles = documents.select(F.col("id").alias("document_id"), F.col("title").alias("document_title"), "user_id")
    return titles.join(rows, "document_id")


def random_documents(documents: DataFrame, chunks: DataFrame, n: int = 50, seed: int = 0) -> DataFrame:
    """n random documents, each with one random chunk of more than 300 characters."""
    known = one_chunk_per_document(documents, chunks, seed)
    chosen = known.orderBy(random_key("user_document_id", seed + 1), "user_document_id").limit(n)
    return with_chunks(F.broadcast(chosen) if n <= BROADCAST_ROWS else chosen, documents, chunks)


def documents_needed(queries: int, per_document: int = QUERIES_PER_DOCUMENT) -> int:
    return -(-queries // per_document)


def number_batches(
    documents: DataFrame, order: tuple[list[Column], Column] | None = None, size: int = GENERATION_BATCH, seed: int = 0
) -> DataFrame:
    """Adds `batch` and `doc_idx` (place in the batch), in a repeatable shuffled order or a given one with its block."""
    numbered = blocked_row_number(documents, *(order or hash_order("document_id", seed)), out="__n")
    place = F.col("__n") - 1
    return numbered.withColumn("batch", F.floor(place / size)).withColumn("doc_idx", place % size).drop("__n")


def attach_queries(
    documents: DataFrame, generated: DataFrame, n: int | None = None, per_document: int = QUERIES_PER_DOCUMENT
) -> DataFrame:
    """Evaluation rows from generated texts.

    `documents`: `batch, doc_idx, ...`; `generated`: `batch, queries array<string>`. Text j of a batch belongs to document
    j div per_document; texts beyond the documents are dropped; ids run from 1 in batch order; n trims the set.
    """
    texts = generated.select("batch", F.posexplode("queries").alias("j", "query_text")).withColumn(
        "doc_idx", F.floor(F.col("j") / per_document)
    )
    rows = texts.join(documents, ["batch", "doc_idx"])
    numbered = blocked_row_number(rows, [F.col("batch"), F.col("j")], F.floor(F.col("batch") / BATCH_BLOCK), out="query_id")
    result = numbered.select(
        "query_id",
        "query_text",
        F.col("chunk_id").alias("ground_truth_chunk_id"),
        F.col("document_id").alias("ground_truth_document_id"),
        F.col("user_id").alias("ground_truth_user_id"),
        F.col("paragraph_id").alias("ground_truth_paragraph_id"),
        "document_title",
        tx.preview(F.col("chunk_text")).alias("chunk_text_preview"),
        F.col("embedding").alias("document_embedding"),
        "meta",
    )
    return result if n is None else first_queries(result, n)


def first_queries(queries: DataFrame, n: int) -> DataFrame:
    """The first n queries by their sequential id."""
    return queries.filter(F.col("query_id") <= n)


def sample_parameters(chunks: DataFrame, above: int = histograms.MIN_COUNT, seed: int = 0) -> DataFrame:
    """A random user with many chunks, with one embedding and one metadata document of theirs (nulls when they have none)."""
    user = random_rows(histograms.groups_over(chunks, "user_id", above), 1, key="user_id", seed=seed).select("user_id")
    mine = chunks.join(F.broadcast(user), "user_id")
    return mine.groupBy("user_id").agg(
        F.min_by("embedding", F.when(F.col("embedding").isNotNull(), F.col("id"))).alias("embedding"),
        F.min_by("meta", F.when(F.col("meta").isNotNull(), F.col("id"))).alias("meta"),
    )


def tenants_of(queries: DataFrame) -> DataFrame:
    return queries.select("ground_truth_user_id").distinct()
