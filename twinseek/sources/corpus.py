"""The search tables derived from plain tables of documents and embeddings.

Twenty tenants own the documents in turn, every line of a document is a chunk, and a document's embedding belongs to its
first line. Columns nobody asks for are pruned down to the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinseek.functions import text as tx
from twinseek.operators.fusion import Corpus
from twinseek.operators.ingest import chunk_features, chunk_meta
from twinseek.operators.keyword import text_index

TENANTS = 20
# Lines a document can have: ids are document and line in one number. More lines are refused, never numbered twice.
LINE_BITS = 27


# Declared schemas spare a footer-reading job per table.
SCHEMAS = {
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "embeddings": "vec_id long, embedding array<float>, label int",
    "labels": "doc_id long, quality int, toxic int",
    "benchmark": "item_id long, text string",
    "pages": "page_id long, url string, html string",
    "conversations": "conv_id long, turn long, role string, text string",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    reader = spark.read.schema(SCHEMAS[name]) if name in SCHEMAS else spark.read
    return reader.parquet(f"{folder}/{name}.parquet")


def chunk_id(document: Column, line: Column) -> Column:
    """Document and line in one number."""
    too_long = F.concat(F.lit("more lines than ids in document "), document.cast("string"))
    checked = F.when(line >= 1 << LINE_BITS, F.raise_error(too_long).cast("long")).otherwise(line.cast("long"))
    return document * F.lit(1 << LINE_BITS) + checked


def users(spark: SparkSession, folder: str) -> DataFrame:
    """One user per tenant that owns a document."""
    return (
        table(spark, folder, "documents")
        .select((F.lit(1) + F.col("doc_id") % TENANTS).alias("id"))
        .distinct()
        .select("id", F.concat(F.lit("user "), F.col("id").cast("string")).alias("name"))
    )


def documents(spark: SparkSession, folder: str) -> DataFrame:
    source = table(spark, folder, "documents").join(
        table(spark, folder, "labels").select("doc_id", "quality"), "doc_id", "left"
    )
    meta = F.to_json(
        F.struct(
            F.col("lang").alias("language"),
            "source",
            tx.word_count(F.col("text")).alias("word_count"),
            "quality",
        ),
        {"ignoreNullFields": "false"},
    )
    return source.select(
        F.col("doc_id").alias("id"),
        (F.lit(1) + F.col("doc_id") % TENANTS).alias("user_id"),
        F.col("doc_id").alias("wiki_id"),
        F.concat(F.lit("https://example.org/"), F.col("doc_id").cast("string")).alias("url"),
        F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"),
        F.col("n_chars").cast("double").alias("views"),
        F.lit(1).alias("langs"),
        meta.alias("meta"),
        F.col("lang").alias("language"),
        "source",
        "quality",
    )


def chunks(spark: SparkSession, folder: str, embedded_only: bool = False) -> DataFrame:
    """Every line of every document. `embedded_only` keeps the lines that have an embedding."""
    lines = (
        table(spark, folder, "documents")
        .withColumn("lines", F.split("text", "\n"))
        .select("doc_id", "lang", F.size("lines").alias("total_chunks"), F.posexplode_outer("lines").alias("paragraph_id", "text"))
        .filter(F.col("text").isNotNull())
    )
    # only first lines meet the embeddings, so the text of the others is not shuffled
    vectors = table(spark, folder, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    first = F.col("paragraph_id") == 0
    rows = lines.filter(first).join(vectors, "doc_id", "inner" if embedded_only else "left")
    if not embedded_only:
        rows = rows.unionByName(lines.filter(~first).withColumn("embedding", F.lit(None).cast("array<float>")))
    key = chunk_id(F.col("doc_id"), F.col("paragraph_id"))
    featured = chunk_features(
        rows.select(
            key.alias("id"),
            F.col("doc_id").alias("user_document_id"),
            (F.lit(1) + F.col("doc_id") % TENANTS).alias("user_id"),
            F.col("paragraph_id").cast("long").alias("paragraph_id"),
            "text",
            "embedding",
            F.col("lang").alias("language_detected"),
            (F.lit(1.0) + (key % 91 * 7919 % 91).cast("double") / F.lit(10.0)).alias("complexity_score"),
            F.timestamp_add("DAY", (key % 730).cast("int"), F.lit("2023-07-01 00:00:00").cast("timestamp")).alias("created_at"),
            F.col("paragraph_id").cast("long").alias("chunk_index"),
            F.col("total_chunks").cast("long").alias("total_chunks"),
        )
    )
    return featured.withColumn("meta", chunk_meta(["language_detected", "complexity_score"]))


def vectors_without_text(spark: SparkSession, folder: str) -> DataFrame:
    """Embeddings that `chunks(embedded_only=True)` has no line for, and whether the document or only its text is missing."""
    documents = table(spark, folder, "documents").select(F.col("doc_id").alias("vec_id"), F.col("text").isNotNull().alias("has_text"))
    known = documents.groupBy("vec_id").agg(F.max("has_text").alias("has_text"))
    reason = F.when(F.col("has_text").isNull(), "no document").otherwise("no text")
    return (
        table(spark, folder, "embeddings")
        .join(known, "vec_id", "left")
        .filter(~F.coalesce("has_text", F.lit(False)))
        .withColumn("reason", reason)
        .drop("has_text")
    )


def corpus(spark: SparkSession, folder: str, dictionary: str = "simple") -> Corpus:
    rows = chunks(spark, folder)
    keep = ["user_document_id", "meta", "created_at", "position", "has_code", "language_detected", "complexity_score"]
    return Corpus(
        chunks=rows,
        documents=documents(spark, folder),
        text=text_index(rows, dictionary, keep),
        vectors=chunks(spark, folder, embedded_only=True),
        dictionary=dictionary,
    )


def known_item_queries(spark: SparkSession, folder: str) -> DataFrame:
    """Every embedded chunk asks for itself: words from its text, its own embedding, itself as the expected answer."""
    return chunks(spark, folder, embedded_only=True).select(
        F.col("id").alias("query_id"),
        "user_id",
        tx.keyword_query_text(F.col("text")).alias("query_text"),
        F.col("embedding").alias("query_embedding"),
        F.col("id").alias("ground_truth_chunk_id"),
        F.col("user_document_id").alias("ground_truth_document_id"),
        F.col("paragraph_id").alias("ground_truth_paragraph_id"),
        "meta",
        "position",
        "has_code",
        "complexity_score",
    )


def source_items(spark: SparkSession, folder: str) -> DataFrame:
    """Paragraph rows in the layout of the paragraph data set, before any grouping."""
    return chunks(spark, folder).join(
        table(spark, folder, "documents").select(
            F.col("doc_id").alias("user_document_id"),
            F.col("n_chars").cast("double").alias("views"),
            F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"),
        ),
        "user_document_id",
    ).select(
        "id",
        "title",
        "text",
        F.concat(F.lit("https://example.org/"), F.col("user_document_id").cast("string")).alias("url"),
        F.col("user_document_id").alias("wiki_id"),
        "views",
        "paragraph_id",
        F.lit(1).alias("langs"),
        F.col("embedding").alias("emb"),
    )
