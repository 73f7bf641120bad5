"""Measured decisions about which side of a join may be sent to every executor."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A side is broadcast only after it was counted and found within both limits.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20


def fits_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Row count and size (of the rows written as JSON, an upper estimate) in one distributed aggregate."""
    found = df.select(F.octet_length(F.to_json(F.struct("*"))).alias("n")).agg(
        F.count("*").alias("rows"), F.coalesce(F.sum("n"), F.lit(0)).alias("bytes")
    )
    row = found.first()
    return row["rows"] <= rows and row["bytes"] <= size
