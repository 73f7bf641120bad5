"""From raw documents to token ids: toxicity, near-duplicates, secrets, mixing, encoding.

Every stage takes all rows its predecessor kept and returns the columns of documents; the last one returns ids. Documents scored toxic
go, one document of each near-duplicate group stays, secrets are masked in the text, and the mix repeats or leaves out documents
so that sources come near their target shares.

Defined cases: null texts are empty texts; of rows that tie as the one to keep, that of the smallest id, then of the smallest digest
stays, and of rows alike in both the first; repeated rows are one group; texts of any length are read whole; empty tables pass through
every stage, and extra columns are carried along to the last one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinseek.llm import bpe, mixing, secrets, simhash, toxicity
from twinseek.llm.common import bound_batches, stored
from twinseek.llm.queries import vocabulary_file

# SQL has no boosted trees, 64-bit text hashes of this kind, balanced samples or byte-pair encoding; tests compare with plain versions.
ORACLE_SQL = None


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents with a score of at least the threshold."""
    bound_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    scored = toxicity.scored(docs, toxicity.train(docs.select("doc_id", "text"), labels))
    return scored.filter(F.col("score") < toxicity.THRESHOLD).select("row.*")


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates: texts whose fingerprints link at two or fewer differing bits."""
    bound_batches(spark)
    return simhash.kept_rows(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask the secrets in the texts."""
    return secrets.redacted_rows(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    bound_batches(spark)
    return mixing.taken_rows(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and whether they decode to its text again."""
    bound_batches(spark)
    vocabulary = bpe.shipped(spark, vocabulary_file())
    ids = docs.select("doc_id", "lang", "source", "text", bpe.encoded(vocabulary, F.col("text")).alias("ids"))
    decoded = ids.withColumn("decoded", bpe.decoded(vocabulary, F.col("ids")))
    return decoded.select(
        "doc_id",
        "lang",
        "source",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        bpe.as_numbers(F.col("ids")).alias("ids"),
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("exact"),
    )


STAGES = [
    ("toxicity", without_toxic),
    ("simhash_near_dedup", without_near_copies),
    ("secret_scan", without_secrets),
    ("mixing", mixed),
    ("bpe", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is stored and read again as the input of the next stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
