"""Reading the paragraph data set."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinseek.operators.ingest import head_slice
from twinseek.schema import ITEM


def read_items(spark: SparkSession, path: str, split: str = "train") -> DataFrame:
    """Declared columns of the items. `train[:N]` takes the N items with the lowest ids."""
    found = re.fullmatch(r"(\w+)(?:\[:(\d+)\])?", split)
    if not found:
        raise ValueError(f"cannot read split {split!r}, expected name or name[:N]")
    items = project_items(spark.read.parquet(path))
    return head_slice(items, ["id"], int(found.group(2))) if found.group(2) else items


def project_items(df: DataFrame) -> DataFrame:
    """Only the declared fields, each in its declared type; other columns are never read."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in ITEM.fields])
