"""Evaluation sets and result files: CSV tables, embedding sidecars, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinseek.schema import EVALUATION_QUERY

CSV_OPTIONS = {"header": True, "quote": '"', "escape": '"', "multiLine": True}
# Columns of the result files and the decimals of their numbers.
RUN_COLUMNS = [
    "search_type", "filter_type", "query_id", "query_text", "latency_ms", "found_ground_truth", "ground_truth_rank",
]
CONFIG_DECIMALS = {
    "avg_ms": 2, "median_ms": 2, "p95_ms": 2, "p99_ms": 2, "recall": 3, "mrr": 3, "qps": 1,
}
# Tokens of a Python literal: quoted strings, names, all between.
LITERAL_TOKENS = r"""'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|[A-Za-z]+|[^'"A-Za-z]+"""
CONFIG_LABELS = ["config", "search_type", "filter_strategy", "schema_design"]


def read_evaluation_set(spark: SparkSession, csv: str, sidecar: str | None = None) -> DataFrame:
    """Evaluation queries with `meta` as JSON text and, from a sidecar, `query_embedding`.

    `meta` may be missing, JSON, or a Python literal; the sidecar's is used where the table has none.
    """
    # the header decides whether there is a meta column
    has_meta = "meta" in spark.read.options(header=True, quote='"', escape='"').csv(csv).columns
    schema = EVALUATION_QUERY if has_meta else EVALUATION_QUERY[:-1]
    queries = spark.read.schema(schema).options(**CSV_OPTIONS).csv(csv)
    if not has_meta:
        queries = queries.withColumn("meta", F.lit(None).cast("string"))
    queries = queries.withColumn("meta", meta_json(F.col("meta")))
    if sidecar is None:
        return queries.withColumn("query_embedding", F.lit(None).cast("array<float>"))
    extra = read_sidecar(spark, sidecar).withColumnRenamed("meta", "sidecar_meta")
    empty = F.coalesce(F.size(F.json_object_keys("meta")) == 0, F.lit(True))
    return (
        queries.join(extra, "query_id", "left")
        .withColumn("meta", F.when(empty & F.col("sidecar_meta").isNotNull(), F.col("sidecar_meta")).otherwise(F.col("meta")))
        .drop("sidecar_meta", "document_embedding")
    )


def _json_token(token: Column) -> Column:
    """One token of a Python literal as JSON: strings in double quotes, tuples as arrays, names of constants."""
    inner = F.substring(token, F.lit(2), F.length(token) - 2)
    bare = F.regexp_replace(F.regexp_replace(inner, r"\\'", "'"), r'(?<!\\)((?:\\\\)*)"', r'$1\\"')
    marks = F.translate(F.regexp_replace(token, r",\s*\)", ")"), "()", "[]")
    return (
        F.when(F.startswith(token, F.lit("'")), F.concat(F.lit('"'), bare, F.lit('"')))
        .when(F.startswith(token, F.lit('"')), F.concat(F.lit('"'), F.regexp_replace(inner, r"\\'", "'"), F.lit('"')))
        .when(token == "True", F.lit("true"))
        .when(token == "False", F.lit("false"))
        .when(token == "None", F.lit("null"))
        .otherwise(marks)
    )


def meta_json(meta: Column) -> Column:
    """JSON text of a JSON or Python-literal dict; `{}` when there is none or it cannot be read."""
    # strings are tokens of their own, so that what they hold is never taken for the literal's punctuation or names
    tokens = F.regexp_extract_all(meta, F.lit(LITERAL_TOKENS), F.lit(0))
    literal = F.array_join(F.transform(tokens, _json_token), "")

    def usable(text: Column) -> Column:
        return F.when(F.try_parse_json(text).isNotNull() & F.json_object_keys(text).isNotNull(), text)

    return F.coalesce(usable(meta), usable(literal), F.lit("{}"))


def read_sidecar(spark: SparkSession, path: str) -> DataFrame:
    """`query_id, query_embedding, document_embedding, meta` from a sidecar.

    Three layouts: JSON lines with those fields (ours, splittable), one JSON object keyed by query id holding such records,
    and the older object keyed by query id holding bare vectors. The last two are one JSON value per file by their format.
    """
    text = spark.read.text(path, wholetext=False)
    lines = text.select(
        F.from_json(
            "value",
            "query_id long, query_embedding array<float>, document_embedding array<float>, meta string",
        ).alias("r")
    ).filter(F.col("r.query_id").isNotNull())
    ours = lines.select("r.*")

    whole = spark.read.text(path, wholetext=True).filter(~F.rlike("value", F.lit(r'^\s*\{"query_id"')))
    entries = whole.select(F.explode(F.from_json("value", "map<string,string>")).alias("key", "value"))
    record = F.from_json("value", "query_embedding array<float>, document_embedding array<float>, meta string")
    bare = F.startswith(F.trim(F.col("value")), F.lit("["))
    keyed = entries.select(
        F.col("key").try_cast("long").alias("query_id"),
        F.when(bare, F.from_json("value", "array<float>")).otherwise(record["query_embedding"]).alias("query_embedding"),
        F.when(~bare, record["document_embedding"]).alias("document_embedding"),
        F.when(~bare, record["meta"]).alias("meta"),
    ).filter(F.col("query_id").isNotNull())
    return ours.unionByName(keyed)


def write_evaluation_set(queries: DataFrame, csv: str, sidecar: str) -> None:
    """The table without vectors as CSV, and the vectors with metadata as JSON lines."""
    names = [f.name for f in EVALUATION_QUERY.fields]
    queries.select(*names).write.mode("overwrite").options(header=True, quote='"', escape='"').csv(csv)
    queries.select("query_id", "query_embedding", "document_embedding", "meta").write.mode("overwrite").json(sidecar)


def write_run_results(results: DataFrame, path: str) -> None:
    results.select(*RUN_COLUMNS).write.mode("overwrite").options(header=True, quote='"', escape='"').csv(path)


def config_table(configs: DataFrame) -> DataFrame:
    """Per-configuration results as text with fixed decimals."""
    numbers = [F.format_string(f"%.{d}f", F.col(c).cast("double")).alias(c) for c, d in CONFIG_DECIMALS.items()]
    return configs.select(*CONFIG_LABELS, *numbers)


def write_config_results(configs: DataFrame, csv: str) -> None:
    config_table(configs).write.mode("overwrite").option("header", True).csv(csv)


def summary_json(configs: DataFrame, summary: DataFrame, queries: int, limit: int) -> DataFrame:
    """One JSON document: run settings, all configurations, summary. One row per configuration, so the list is short."""
    listed = configs.agg(F.sort_array(F.collect_list(F.struct("config", *[c for c in configs.columns if c != "config"]))).alias("results"))
    settings = F.struct(F.lit(queries).alias("queries"), F.lit(limit).alias("limit")).alias("config")
    totals = summary.select(F.struct("*").alias("summary"))
    # both sides are single rows
    return listed.withColumn("one", F.lit(1)).join(totals.withColumn("one", F.lit(1)), "one").select(
        F.to_json(F.struct(settings, "results", "summary")).alias("value")
    )


def write_summary(configs: DataFrame, summary: DataFrame, queries: int, limit: int, path: str) -> None:
    summary_json(configs, summary, queries, limit).write.mode("overwrite").text(path)
