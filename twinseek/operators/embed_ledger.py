"""Embeddings by content: a text is embedded once per model and input type, wherever and however often it occurs.

    rows/part=V/     digest, input_type, model, embedding
    log/version=V/   what part V holds; a part counts once its entry is there

New texts are embedded in slices, each committed on its own: a run that stops has paid for the slices that are done and no other, and the
next run takes up the rest.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinseek.operators.embed import Embedder, embed
from twinseek.session import cut_lineage
from twinseek.sources import commits

ROWS = "digest string, input_type string, model string, embedding array<float>"
ENTRY = "input_type string, model string, texts long"
# Texts of a slice, about.
SLICE_TEXTS = 100_000


def digest_of(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def ledger(spark: SparkSession, folder: str) -> DataFrame:
    """All embeddings of committed parts."""
    parts = commits.versions(spark, folder)
    if not parts:
        return spark.createDataFrame([], ROWS)
    return spark.read.schema(ROWS).parquet(*[f"{folder}/rows/part={p}" for p in parts])


def embed_new(
    rows: DataFrame,
    text: str,
    make_embedder: Callable[[], Embedder],
    folder: str,
    model: str,
    input_type: str = "search_document",
    slice_texts: int = SLICE_TEXTS,
) -> int:
    """Embed the texts that the ledger does not hold for this model and input type; how many these were."""
    spark = rows.sparkSession
    held = ledger(spark, folder).filter((F.col("model") == model) & (F.col("input_type") == input_type))
    texts = rows.select(F.coalesce(text, F.lit("")).alias("text")).withColumn("digest", digest_of(F.col("text")))
    # copies become one row before anything is shuffled whole
    new = cut_lineage(texts.groupBy("digest").agg(F.min("text").alias("text")).join(held.select("digest"), "digest", "left_anti"))
    n = new.count()
    slices = -(-n // slice_texts)
    number = F.pmod(F.xxhash64("digest"), F.lit(max(1, slices)))
    for i in range(slices):
        part = max(commits.versions(spark, folder), default=-1) + 1
        made = embed(new.filter(number == i), "text", make_embedder, input_type=input_type)
        own = made.select("digest", F.lit(input_type).alias("input_type"), F.lit(model).alias("model"), "embedding")
        own.write.mode("overwrite").parquet(f"{folder}/rows/part={part}")
        written = spark.read.schema(ROWS).parquet(f"{folder}/rows/part={part}").count()
        commits.commit(spark.createDataFrame([(input_type, model, written)], ENTRY), folder, part)
    return n


def embed_through(
    rows: DataFrame,
    text: str,
    make_embedder: Callable[[], Embedder],
    folder: str,
    model: str,
    out: str = "embedding",
    input_type: str = "search_document",
    slice_texts: int = SLICE_TEXTS,
) -> tuple[DataFrame, int]:
    """The rows with their vectors, and how many texts had to be embedded for it."""
    n = embed_new(rows, text, make_embedder, folder, model, input_type, slice_texts)
    held = ledger(rows.sparkSession, folder).filter((F.col("model") == model) & (F.col("input_type") == input_type))
    # a text that very many rows share is one row here, and the other side can be split
    vectors = held.select(F.col("digest").alias("__digest"), F.col("embedding").alias(out))
    return rows.withColumn("__digest", digest_of(F.col(text))).join(vectors, "__digest", "left").drop("__digest"), n
