"""Samples of a stored table that read a share of its files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A draw is made in steps of one millionth; a sample reads that many files at least, or all of fewer.
STEPS, LEAST_FILES = 1_000_000, 32


def _drawn(value, share: float, seed: int):
    return F.pmod(F.xxhash64(value, F.lit(seed)), F.lit(STEPS)) < F.lit(round(share * STEPS))


def block_shares(files: int, share: float) -> tuple[float, float]:
    """Share of the files to read, and share of their rows to keep, which together make the wanted one."""
    of_files = min(1.0, max(share, LEAST_FILES / max(files, 1)))
    return of_files, share / of_files


def block_sample(spark: SparkSession, path: str, share: float, key: str = "id", seed: int = 0) -> DataFrame:
    """About a share of a stored Parquet table, the same whenever it is drawn from the same files.

    Files are the blocks: which of them are read is settled by name when the scan is planned, so the others are not opened. Where a table
    has few files more of them are read, and rows are drawn by hash of `key` inside.
    """
    if not 0 <= share <= 1:
        raise ValueError(f"no share: {share}")
    table = spark.read.parquet(path)
    of_files, of_rows = block_shares(len(table.inputFiles()), share)
    chosen = table.filter(_drawn(F.col("_metadata.file_name"), of_files, seed)) if of_files < 1 else table
    return chosen.filter(_drawn(F.col(key), of_rows, seed + 1)) if of_rows < 1 else chosen
