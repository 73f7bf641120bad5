"""The registered queries of the training-data operators: each over its whole table, with production parameters."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinseek.llm import bpe, conversation_repair, hard_negatives, mixing, secrets, sharding, simhash, spotsigs, substring_dedup, suffix_dedup, topk, toxicity, warc
from twinseek.llm.common import bound_batches, documents, shared, stored

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}

SHARDS = 8
TOP, QUERY_EVERY = 10, 100


def register(function: Query) -> Query:
    REGISTRY[function.__name__] = function
    return function


@register
def op1_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    bound_batches(spark)
    return substring_dedup.dedup(documents(spark, folder, "doc_id", "text"))


@register
def op2_mixing(spark: SparkSession, folder: str) -> DataFrame:
    bound_batches(spark)
    return mixing.mix(documents(spark, folder, "doc_id", "source", "text")).select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (F.col("size") * (F.col("whole") + F.col("chosen"))).alias("taken"),
        "source",
    )


@register
def op3_topk(spark: SparkSession, folder: str) -> DataFrame:
    bound_batches(spark)
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding")
    return topk.top_k(vectors, F.col("vec_id") % QUERY_EVERY == 0, TOP)


@register
def op4_simhash(spark: SparkSession, folder: str) -> DataFrame:
    bound_batches(spark)
    return simhash.grouped(documents(spark, folder, "doc_id", "text")).select(
        "doc_id", F.lpad(F.lower(F.hex("code")), 16, "0").alias("fingerprint"), "component_id"
    )


@register
def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    bound_batches(spark)
    docs = documents(spark, folder, "doc_id", "text")
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "toxic")
    found = toxicity.scored(docs, toxicity.train(docs, labels))
    return found.select(
        "row.doc_id",
        toxicity.held_out(F.col("row.doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
    )


@register
def op6_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    bound_batches(spark)
    return suffix_dedup.dedup(documents(spark, folder, "doc_id", "text"))


@register
def op7_spotsigs(spark: SparkSession, folder: str) -> DataFrame:
    bound_batches(spark)
    return spotsigs.compared_with_edits(documents(spark, folder, "doc_id", "text"))


def vocabulary_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@register
def op8_bpe(spark: SparkSession, folder: str) -> DataFrame:
    bound_batches(spark)
    vocabulary = bpe.shipped(spark, vocabulary_file())
    ids = documents(spark, folder, "doc_id", "text").select("doc_id", bpe.encoded(vocabulary, F.col("text")).alias("ids"))
    texts = ids.withColumn("decoded", bpe.decoded(vocabulary, F.col("ids")))
    return texts.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )


@register
def op9_secrets(spark: SparkSession, folder: str) -> DataFrame:
    paths = documents(spark, folder, "doc_id", "text")
    found = secrets.report(paths, secrets.scan(paths)).drop("text")
    of = F.col("__spans")
    counts = [secrets.counted(of, i).alias(f"n_{rule.kind}") for i, rule in enumerate(secrets.RULES)]
    listed = secrets.written(of)
    return found.select("doc_id", *counts, F.sha2(listed, 256).alias("base_sha256"), listed.alias("spans"))


@register
def op10_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shard(documents(spark, folder, "doc_id", "text"), SHARDS)


@register
def op11_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    bound_batches(spark)
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding", "label")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(vectors.withColumn("label", moved), F.col("vec_id") % QUERY_EVERY == 0)


@register
def op12_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    bound_batches(spark)
    rows = spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return conversation_repair.with_all(conversation_repair.report(conversation_repair.damaged(rows)), rows)


@register
def op13_warc(spark: SparkSession, folder: str) -> DataFrame:
    bound_batches(spark)
    place = f"{shared(spark)}/warc-{uuid.uuid4().hex}"
    warc.write(spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "url", "html"), place)
    return warc.resolved(stored(warc.read(spark, place), "records"))
