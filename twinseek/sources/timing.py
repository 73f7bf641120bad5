"""Timing reports: folders of text files with `Planning Time: x ms` lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Labels of the timing lines, the pattern of a line, and the report that only summarises others.
LABELS = {"Execution Time": "execution_time", "Planning Time": "planning_time", "Total Time": "total_time"}
LINE_PATTERN = r"^(Execution Time|Planning Time|Total Time):\s*([0-9.]+)\s*ms"
SUMMARY_REPORT = "summary"


def read_reports(spark: SparkSession, folder: str) -> DataFrame:
    """`name, line_no, value` of every report line; a report is one small file, read whole to keep its line order."""
    files = spark.read.text(folder, wholetext=True).select(
        F.regexp_replace(F.col("_metadata.file_name"), r"\.txt$", "").alias("name"), "value"
    )
    return files.select("name", F.posexplode(F.split("value", "\n")).alias("line_no", "value"))


def timings(lines: DataFrame) -> DataFrame:
    """Last value of each label per report; reports without a total are left out."""
    parsed = lines.select(
        "name",
        "line_no",
        F.regexp_extract("value", LINE_PATTERN, 1).alias("label"),
        F.regexp_extract("value", LINE_PATTERN, 2).try_cast("double").alias("ms"),
    ).filter((F.col("label") != "") & (F.col("name") != SUMMARY_REPORT))
    last = [
        F.max_by(F.when(F.col("label") == label, F.col("ms")), F.when(F.col("label") == label, F.col("line_no"))).alias(out)
        for label, out in LABELS.items()
    ]
    return parsed.groupBy("name").agg(*last).filter(F.col("total_time").isNotNull())


def ranked_timings(reports: DataFrame) -> DataFrame:
    return reports.orderBy("total_time", "name")


def timing_range(reports: DataFrame) -> DataFrame:
    """Fastest and slowest report and the ratio between them."""
    return reports.agg(
        F.min_by("name", F.struct("total_time", "name")).alias("fastest"),
        F.min("total_time").alias("fastest_ms"),
        F.max_by("name", F.struct("total_time", "name")).alias("slowest"),
        F.max("total_time").alias("slowest_ms"),
        F.try_divide(F.max("total_time"), F.min("total_time")).alias("range_ratio"),
    )
