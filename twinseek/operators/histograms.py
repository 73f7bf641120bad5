"""Counts over metadata and tenants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinseek.functions.json import json_has_key, json_text

# Sizes of the key and value lists, the count a value or a tenant must exceed, values to choose from.
TOP_KEYS = 10
TOP_VALUES = 10
DISTINCT_KEYS = 5
MIN_COUNT = 100
VALUE_CHOICES = 5
KEY_CHOICES = 3


def key_counts(df: DataFrame, meta: str = "meta") -> DataFrame:
    return (
        df.filter(F.col(meta).isNotNull())
        .select(F.explode(F.json_object_keys(meta)).alias("key"))
        .groupBy("key")
        .agg(F.count("*").alias("count"))
    )


def key_histogram(df: DataFrame, top: int = TOP_KEYS, meta: str = "meta") -> DataFrame:
    """The most frequent metadata keys."""
    return key_counts(df, meta).orderBy(F.desc("count"), "key").limit(top)


def distinct_keys(df: DataFrame, n: int = DISTINCT_KEYS, meta: str = "meta") -> DataFrame:
    return df.select(F.explode(F.json_object_keys(meta)).alias("key")).distinct().orderBy("key").limit(n)


def value_histogram(df: DataFrame, key: str, top: int = TOP_VALUES, meta: str = "meta") -> DataFrame:
    """The most frequent values of one key, as text."""
    value = json_text(F.col(meta), key)
    return (
        df.filter(json_has_key(F.col(meta), key) & value.isNotNull())
        .groupBy(value.alias("val"))
        .agg(F.count("*").alias("cnt"))
        .orderBy(F.desc("cnt"), "val")
        .limit(top)
    )


def frequent_values(histogram: DataFrame, above: int = MIN_COUNT, n: int = VALUE_CHOICES) -> DataFrame:
    return histogram.filter(F.col("cnt") > above).orderBy(F.desc("cnt"), "val").limit(n)


def groups_over(df: DataFrame, key: str | Column = "user_id", above: int = MIN_COUNT) -> DataFrame:
    """Groups with more rows than a threshold."""
    return df.groupBy(key).agg(F.count("*").alias("chunk_count")).filter(F.col("chunk_count") > above)
