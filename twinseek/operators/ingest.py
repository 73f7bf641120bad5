"""Paragraphs to documents and chunks: grouping, tenant assignment, features, metadata, statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinseek.functions import text as tx
from twinseek.operators.ranking import blocked_row_number, hash_order

# Paragraphs of one document are numbered in blocks of this many source positions.
ORDINAL_BLOCK = 1 << 16
FEATURES = [
    "position", "word_count", "char_count", "sentence_count", "has_code", "has_math", "has_list", "has_table",
]


def head_slice(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """The first n rows in a stated order: Spark rows have none of their own."""
    return df.orderBy(*order).limit(n)


def group_documents(items: DataFrame, order: str = "id") -> DataFrame:
    """One row per url: attributes of its first paragraph, words of all of them. Partial aggregates before the shuffle."""
    first = F.min_by(F.struct("title", "wiki_id", "views", "langs"), F.col(order))
    return (
        items.groupBy("url")
        .agg(
            first.alias("first"),
            F.count("*").alias("n_chunks"),
            F.sum(tx.word_count(F.col("text"))).alias("word_count"),
        )
        .select("url", "first.title", "first.wiki_id", "first.views", "first.langs", "n_chunks", "word_count")
    )


def chunk_ordinals(items: DataFrame, order: str = "id", block: int = ORDINAL_BLOCK) -> DataFrame:
    """Adds `chunk_index` (0-based place in its document) and `total_chunks`; a document of any length is split."""
    numbered = blocked_row_number(
        items, [F.col(order)], F.floor(F.col(order) / block), by=["url"], out="chunk_index", total="total_chunks"
    )
    return numbered.withColumn("chunk_index", F.col("chunk_index") - 1)


def assign_users(
    documents: DataFrame,
    users: DataFrame,
    max_documents: int = 10,
    order: tuple[list[Column], Column] | None = None,
    seed: int = 0,
) -> DataFrame:
    """Deal documents evenly to users: d // u each, one more for the first d % u users, never above the cap.

    Documents are taken in a repeatable shuffled order (or the given order with its block). What the caps leave over stays
    unassigned and is dropped. The user of a document follows from its place by arithmetic.
    """
    order = order or hash_order("url", seed)
    n_documents, n_users = documents.count(), users.count()
    if n_users == 0 or n_documents == 0:
        return documents.withColumn("user_id", F.lit(None).cast("long")).limit(0)
    share, extra = divmod(n_documents, n_users)
    large, small = min(share + 1, max_documents), min(share, max_documents)
    place = F.col("__place") - 1
    later = F.lit(extra) + F.floor((place - extra * large) / small) if small else F.lit(n_users)
    index = F.when(place < extra * large, F.floor(place / large)).otherwise(later).cast("long")
    dealt = blocked_row_number(documents, *order, out="__place").withColumn("__user", index)
    owners = blocked_row_number(
        users.select(F.col("id").alias("user_id")), [F.col("user_id")], F.floor(F.col("user_id") / ORDINAL_BLOCK), out="__user"
    ).withColumn("__user", F.col("__user") - 1)
    return dealt.filter(F.col("__user") < n_users).join(owners, "__user").drop("__user", "__place")


def denormalise(items: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunks of assigned documents with `user_document_id` and `user_id` of their document."""
    owners = documents.select("url", F.col("id").alias("user_document_id"), "user_id")
    return items.join(owners, "url")


def chunk_features(chunks: DataFrame) -> DataFrame:
    """Adds the text features; expects `text`, `chunk_index`, `total_chunks`."""
    t = F.col("text")
    return chunks.withColumns(
        {
            "section_type": tx.section_label(F.col("chunk_index")),
            "position": tx.position_label(F.col("chunk_index"), F.col("total_chunks")),
            "word_count": tx.word_count(t),
            "char_count": tx.char_count(t),
            "sentence_count": tx.sentence_count(t),
            "has_code": tx.has_code(t),
            "has_math": tx.has_math(t),
            "has_list": tx.has_list(t),
            "has_table": tx.has_table(t),
        }
    )


def chunk_meta(extra: Sequence[str] = ()) -> Column:
    """Chunk metadata as JSON text, from the feature columns and any further columns."""
    return F.to_json(F.struct("section_type", *FEATURES, *extra))


def document_meta(extra: Sequence[str] = ()) -> Column:
    return F.to_json(F.struct("word_count", *extra))


def with_defaults(df: DataFrame, now: Column | None = None) -> DataFrame:
    """Empty metadata and the creation time where they are missing."""
    now = F.current_timestamp() if now is None else now
    for name, value in (("created_at", now), ("meta", F.lit("{}"))):
        current = F.col(name) if name in df.columns else F.lit(None)
        df = df.withColumn(name, F.coalesce(current, value))
    return df


def statistics(users: DataFrame, documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Row counts of the three tables and documents per user, 0 without users. Three partial counts, one row."""
    counts = None
    for name, df in (("users", users), ("documents", documents), ("chunks", chunks)):
        part = df.agg(F.count("*").alias("n")).withColumn("name", F.lit(name))
        counts = part if counts is None else counts.unionByName(part)

    def total(name: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("name") == name, F.col("n"))), F.lit(0))

    return counts.agg(
        total("users").alias("total_users"),
        total("documents").alias("total_documents"),
        total("chunks").alias("total_chunks"),
        F.coalesce(F.try_divide(total("documents").cast("double"), total("users").cast("double")), F.lit(0.0)).alias(
            "avg_docs_per_user"
        ),
    )


def ingest(items: DataFrame, users: DataFrame, max_documents: int = 10, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Documents and chunks of a paragraph table: grouped, dealt to users, denormalised, with features and metadata.

    Ids derive from the wiki id and the paragraph number, so a repeated run writes the same rows.
    """
    documents = assign_users(group_documents(items), users, max_documents, seed=seed)
    documents = with_defaults(
        documents.withColumn("id", F.xxhash64("user_id", "url")).withColumn("meta", document_meta())
    )
    chunks = denormalise(chunk_ordinals(items.drop("title", "views", "langs", "wiki_id")), documents)
    chunks = chunk_features(
        chunks.withColumn("id", F.xxhash64("user_document_id", "paragraph_id")).withColumnRenamed("emb", "embedding")
    )
    chunks = with_defaults(chunks.withColumn("meta", chunk_meta()))
    columns = ["id", "user_document_id", "user_id", "paragraph_id", "text", "embedding", "meta", "created_at", *FEATURES]
    return documents, chunks.select(*columns)
