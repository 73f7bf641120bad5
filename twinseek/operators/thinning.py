"""A bit table of bounded size that thins the large side of an exact join, so that the join shuffles few rows without a partner."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bits of the table: 8 MB travel to the tasks, and 16 MB of marked words at most to the driver.
PLACES = 1 << 26


def _place(key: Sequence[str]) -> Column:
    return F.pmod(F.xxhash64(*[F.col(c).cast("string") for c in key]), F.lit(PLACES))


def thinned(rows: DataFrame, wanted: DataFrame, key: Sequence[str]) -> DataFrame:
    """All rows with a key of `wanted` (integers or texts) and few others. `wanted` is read once, at once."""
    bit = F.expr("shiftleft(1L, cast(place % 64 as int))")
    marks = wanted.select(_place(key).alias("place")).groupBy(F.floor(F.col("place") / 64).alias("at")).agg(F.bit_or(bit).alias("bits"))
    found = marks.toArrow()
    table = np.zeros(PLACES // 64, np.uint64)
    table[found["at"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)

    @F.arrow_udf("boolean")
    def may_be_wanted(places: pa.Array) -> pa.Array:
        place = places.to_numpy()
        return pa.array((table[place // 64] >> (place % 64).astype(np.uint64)) & np.uint64(1) > 0)

    return rows.filter(may_be_wanted(_place(key)))
