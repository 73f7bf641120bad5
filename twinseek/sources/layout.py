"""Table layout for scale: tenant partitions, text and vectors apart, hot metadata keys as typed columns.

    documents/   partitioned by user_bucket, sorted by (user_id, id)
    chunks/      the same: payload (text, metadata)
    text/        the same: text vectors and filter columns, no text, no embeddings
    vectors/     the same: embeddings and filter columns
    postings/    range-clustered by (lexeme, id)
    blocks/      on request: block postings, range-clustered by (lexeme, user_id, weight)
    vocabulary/  lexeme counts
    manifest/    one row: tenant buckets, dictionary, dimension of the embeddings
    staging/     the derived chunk rows the narrower tables are read from; may be dropped afterwards
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from twinseek.operators.blockmax import blocks_of
from twinseek.operators.fusion import Corpus, user_bucket
from twinseek.operators.keyword import chunk_postings, postings, postings_vocabulary, text_index

USER_BUCKETS = 64
# Codec of all tables: sorted postings, text vectors and chunks take a fifth to a third less than with the default.
CODEC = "zstd"
MANIFEST = "buckets int, dictionary string, dimension int"
# Metadata keys that filters use often, kept as typed columns.
HOT_KEYS = {
    "position": "string",
    "has_code": "boolean",
    "complexity_score": "double",
    "language_detected": "string",
}


def promote_hot_keys(chunks: DataFrame) -> DataFrame:
    """Typed columns for the hot keys; a value that does not fit its type becomes null."""
    missing = [k for k in HOT_KEYS if k not in chunks.columns]
    return chunks.withColumns({k: F.get_json_object("meta", f"$.{k}").try_cast(HOT_KEYS[k]) for k in missing})


def write_by_tenant(df: DataFrame, path: str, buckets: int = USER_BUCKETS, mode: str = "overwrite") -> None:
    """One partition per tenant bucket, one shuffle.

    The rebalance lets AQE cut the partition of a large tenant into files of the advised size and join up small ones.
    """
    _write_sorted(
        df.withColumn("user_bucket", user_bucket(F.col("user_id"), buckets)).hint("rebalance", F.col("user_bucket")), path, mode
    )


def _write_sorted(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    (
        df.sortWithinPartitions("user_bucket", "user_id", "id")
        .write.mode(mode)
        .partitionBy("user_bucket")
        .parquet(path, compression=CODEC)
    )


def write_corpus(
    documents: DataFrame,
    chunks: DataFrame,
    folder: str,
    dictionary: str = "english",
    buckets: int = USER_BUCKETS,
    users: DataFrame | None = None,
    blocks: bool = False,
) -> None:
    """Write all tables of a searchable corpus; block postings, for ranked searches that stop early, where `blocks` asks for them.

    The chunks are derived and shuffled once; the narrower tables read them back, already clustered, without a shuffle.
    """
    spark = documents.sparkSession
    if users is not None:
        users.write.mode("overwrite").parquet(f"{folder}/users")
    write_by_tenant(documents, f"{folder}/documents", buckets)
    write_by_tenant(promote_hot_keys(chunks), f"{folder}/staging", buckets)
    rows = spark.read.parquet(f"{folder}/staging")
    filters = ["user_document_id", "meta", "created_at", *HOT_KEYS]
    _write_sorted(rows.drop("embedding"), f"{folder}/chunks")
    _write_sorted(
        rows.filter(F.col("embedding").isNotNull()).select("id", "user_id", *filters, "embedding", "user_bucket"),
        f"{folder}/vectors",
    )
    _write_sorted(text_index(rows, dictionary, [*filters, "user_bucket"]), f"{folder}/text")
    index = spark.read.parquet(f"{folder}/text")
    lines = postings(index, ["user_document_id"]).unionByName(chunk_postings(index, ["user_document_id"]))
    # range clustering splits a word that occurs everywhere over several files
    lines.repartitionByRange("lexeme", "id").sortWithinPartitions("lexeme", "id").write.mode("overwrite").parquet(
        f"{folder}/postings", compression=CODEC
    )
    # what is derived from postings reads them as they lie, without another shuffle
    lines = spark.read.parquet(f"{folder}/postings")
    if blocks:
        blocks_of(lines, ["user_document_id"]).write.mode("overwrite").parquet(f"{folder}/blocks", compression=CODEC)
    postings_vocabulary(lines).write.mode("overwrite").parquet(f"{folder}/vocabulary", compression=CODEC)
    sizes = spark.read.parquet(f"{folder}/vectors").agg(
        F.min(F.size("embedding")).alias("least"), F.max(F.size("embedding")).alias("dimension")
    )
    found = sizes.first()
    if found["least"] != found["dimension"]:
        raise ValueError(f"embeddings of {found['least']} to {found['dimension']} numbers in one corpus")
    write_manifest(spark, folder, buckets, dictionary, found["dimension"])


def write_manifest(spark: SparkSession, folder: str, buckets: int, dictionary: str, dimension: int | None) -> None:
    row = spark.createDataFrame([(buckets, dictionary, dimension)], MANIFEST)
    row.coalesce(1).write.mode("overwrite").parquet(f"{folder}/manifest")


def read_manifest(spark: SparkSession, folder: str) -> Row:
    """What the tables were written with; pruning with other values would lose rows."""
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").first()


def read_corpus(
    spark: SparkSession,
    folder: str,
    dictionary: str | None = None,
    buckets: int | None = None,
    use_postings: bool = False,
    use_vocabulary: bool = False,
    use_blocks: bool = False,
) -> Corpus:
    """The stored tables. Bucket count and dictionary come from the manifest; others than those are refused. Postings pay off for small batches on large corpora, the vocabulary where common words are long."""
    written = read_manifest(spark, folder)
    for name, asked in (("buckets", buckets), ("dictionary", dictionary)):
        if asked is not None and asked != written[name]:
            raise ValueError(f"{folder} was written with {name} {written[name]!r}, not {asked!r}")
    return Corpus(
        chunks=spark.read.parquet(f"{folder}/chunks"),
        documents=spark.read.parquet(f"{folder}/documents"),
        text=spark.read.parquet(f"{folder}/text"),
        vectors=spark.read.parquet(f"{folder}/vectors"),
        dictionary=written["dictionary"],
        vocabulary=spark.read.parquet(f"{folder}/vocabulary") if use_vocabulary else None,
        postings=spark.read.parquet(f"{folder}/postings") if use_postings or use_blocks else None,
        blocks=spark.read.parquet(f"{folder}/blocks") if use_blocks else None,
        user_buckets=written["buckets"],
    )


def files_of_tenant(df: DataFrame, user_id: int, buckets: int | None) -> DataFrame:
    """Rows of one tenant, with the partition named, if the bucket count is known, so that no other is listed or read."""
    if buckets is not None and "user_bucket" in df.columns:
        df = df.filter(F.col("user_bucket") == user_bucket(F.lit(user_id), buckets))
    return df.filter(F.col("user_id") == user_id)


