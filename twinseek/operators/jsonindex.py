"""Postings of JSON metadata: which rows hold which value at which path, so that a filter reads matching ids and parses nothing.

A path names keys from the root; an array adds `[]` and not the place in it. Every scalar has a posting with its type and value, every
object and array one that says it is there. Filters are those of `functions.json.json_contains`: a filter of keys and values, nested
to any depth, holds where all its paths and values do. Only where an array of the filter holds objects or arrays of several values do
these have to come from one element; what the postings find is then checked against the stored VARIANT of those rows.
"""

from __future__ import annotations

from functools import reduce
from operator import or_
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinseek.functions.json import variant_contains
from twinseek.session import cut_lineage

ROOT = "$"
# Values of more characters are known by their digest.
LONGEST = 64
NUMBERS = "^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$"
OBJECT, ARRAY = "{}", "[]"


def _kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def _scalar(value: Column) -> Column:
    """Type and value as text; numbers that are equal have equal texts."""
    kind = _kind(value)
    text = F.try_variant_get(value, "$", "string")
    return (
        F.when(F.rlike(kind, F.lit(NUMBERS)), _number(F.try_variant_get(value, "$", "double")))
        .when(kind == "BOOLEAN", F.concat(F.lit("b:"), text))
        .when(kind == "STRING", _string(text))
        .otherwise(F.lit("null"))
    )


def _number(value: Column) -> Column:
    # the sum turns the negative zero into the other one
    return F.concat(F.lit("n:"), (value + F.lit(0.0)).cast("string"))


def _string(value: Column) -> Column:
    return F.when(F.length(value) <= LONGEST, F.concat(F.lit("s:"), value)).otherwise(F.concat(F.lit("h:"), F.sha2(value, 256)))


def _escaped(key: str) -> str:
    return key.replace("\\", "\\\\").replace(".", "\\.").replace("[", "\\[")


def json_postings(rows: DataFrame, column: str = "meta") -> DataFrame:
    """`path, value, id` for every value in the JSON text of `column`, each once per row; text that is no JSON has none.

    One pass per level of nesting; the levels are as many as the deepest row has.
    """
    level = rows.select("id", F.lit(ROOT).alias("path"), F.try_parse_json(column).alias("v")).filter(F.col("v").isNotNull())
    found = None
    while True:
        level = cut_lineage(level)
        is_object, is_array = F.startswith(_kind(F.col("v")), F.lit("OBJECT")), F.startswith(_kind(F.col("v")), F.lit("ARRAY"))
        value = F.when(is_object, F.lit(OBJECT)).when(is_array, F.lit(ARRAY)).otherwise(_scalar(F.col("v")))
        own = level.select("path", value.alias("value"), "id")
        found = own if found is None else found.unionByName(own)
        inner = level.filter(is_object | is_array)
        if inner.isEmpty():
            return found.distinct()
        escaped = F.replace(F.replace(F.replace("key", F.lit("\\"), F.lit("\\\\")), F.lit("."), F.lit("\\.")), F.lit("["), F.lit("\\["))
        step = F.when(F.col("key").isNull(), F.lit("[]")).otherwise(F.concat(F.lit("."), escaped))
        children = inner.withColumnRenamed("v", "parent")
        exploded = children.lateralJoin(rows.sparkSession.tvf.variant_explode(F.col("parent").outer()))
        level = exploded.select("id", F.concat("path", step).alias("path"), F.col("value").alias("v"))


def write_json(rows: DataFrame, folder: str, column: str = "meta") -> None:
    """Postings, range-clustered by path and value, and the metadata as VARIANT."""
    order = ["path", "value", "id"]
    json_postings(rows, column).repartitionByRange(*order).sortWithinPartitions(*order).write.parquet(f"{folder}/json_postings")
    rows.select("id", F.try_parse_json(column).alias("v")).write.parquet(f"{folder}/json")


def read_json(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Postings and VARIANT rows as written."""
    return spark.read.parquet(f"{folder}/json_postings"), spark.read.parquet(f"{folder}/json")


def conditions(wanted: Any, path: str = ROOT) -> list[tuple[str, Column, tuple]]:
    """Paths and values that a row must have to contain `wanted`; the third part tells equal ones apart from others."""
    if isinstance(wanted, dict):
        inner = [c for k, v in wanted.items() for c in conditions(v, f"{path}.{_escaped(k)}")]
        return inner or [(path, F.lit(OBJECT), (path, OBJECT))]
    if isinstance(wanted, (list, tuple)):
        inner = [c for v in wanted for c in conditions(v, f"{path}[]")]
        return inner or [(path, F.lit(ARRAY), (path, ARRAY))]
    if wanted is None:
        return [(path, F.lit("null"), (path, None))]
    if isinstance(wanted, bool):
        text = f"b:{str(wanted).lower()}"
        return [(path, F.lit(text), (path, text))]
    if isinstance(wanted, (int, float)):
        return [(path, _number(F.lit(float(wanted))), (path, float(wanted)))]
    return [(path, _string(F.lit(str(wanted))), (path, str(wanted), "s"))]


def _one_element(wanted: Any) -> bool:
    """Whether several values of the filter have to come from one element of an array."""
    if isinstance(wanted, dict):
        return any(map(_one_element, wanted.values()))
    if isinstance(wanted, (list, tuple)):
        return any(_one_element(w) or (isinstance(w, (dict, list, tuple)) and len(conditions(w)) > 1) for w in wanted)
    return False


def containing(postings: DataFrame, variants: DataFrame, wanted: dict | list) -> DataFrame:
    """`id` of the rows whose metadata contains `wanted`."""
    needed = {key: (path, value) for path, value, key in conditions(wanted)}
    held = reduce(or_, [(F.col("path") == path) & (F.col("value") == value) for path, value in needed.values()])
    # a row has every posting once, so counting them is enough
    found = postings.filter(held).groupBy("id").agg(F.count("*").alias("n")).filter(F.col("n") == len(needed)).select("id")
    if not _one_element(wanted):
        return found
    return variants.join(found, "id", "left_semi").filter(variant_contains(F.col("v"), wanted)).select("id")


def having_key(postings: DataFrame, key: str) -> DataFrame:
    """`id` of the rows that have a top-level key, whatever its value."""
    return postings.filter(F.col("path") == f"{ROOT}.{_escaped(key)}").select("id").distinct()
