"""The most frequent values of a column, counted exactly without shuffling all distinct values.

Every task keeps a summary of at most 2 x CAPACITY values (Misra and Gries, 1982): when it overflows, the count of the (CAPACITY + 1)-th
is taken from all and what has nothing left goes, so no count falls short by more than what was taken. Summaries add up. With E taken in
all tasks together and L the k-th greatest summed count, a value outside the summaries occurs E times at most; if L exceeds E, the k most
frequent are among the values whose count plus E reaches L, and only these are counted exactly. Where L does not exceed E, nothing
is proved and all values are counted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinseek.operators.sizing import fits_broadcast
from twinseek.session import cut_lineage

CAPACITY = 4096


def _summary(capacity: int):
    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, int] = {}
        taken = 0
        for batch in batches:
            for pair in pc.value_counts(batch.column(0)):
                value = pair["values"].as_py()
                counts[value] = counts.get(value, 0) + pair["counts"].as_py()
            if len(counts) > 2 * capacity:
                held = np.fromiter(counts.values(), np.int64, len(counts))
                least = int(np.partition(held, -capacity - 1)[-capacity - 1])
                counts = {v: n - least for v, n in counts.items() if n > least}
                taken += least
        values = [*counts, None]
        # the last row says how much was taken
        yield pa.record_batch([pa.array(values, pa.string()), pa.array([*counts.values(), taken], pa.int64())], ["val", "n"])

    return summary


def summaries(values: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """`val, n`: summed counts that fall short by `n` of the null value at most."""
    return values.mapInArrow(_summary(capacity), "val string, n long").groupBy("val").agg(F.sum("n").alias("n"))


def most_frequent(values: DataFrame, top: int, capacity: int = CAPACITY) -> DataFrame:
    """`val, cnt`: the `top` most frequent values of a text column (null left out), ties by value. Exact."""
    own = values.select(F.col(values.columns[0]).alias("val")).filter(F.col("val").isNotNull())
    summed = cut_lineage(summaries(own, capacity))
    greatest = summed.filter(F.col("val").isNotNull()).orderBy(F.desc("n"), "val").limit(top).select("n").collect()
    taken = summed.filter(F.col("val").isNull()).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    candidates = own
    if taken and len(greatest) == top and (kth := greatest[-1]["n"]) > taken:
        chosen = summed.filter(F.col("val").isNotNull() & (F.col("n") >= kth - taken)).select("val")
        candidates = own.join(F.broadcast(chosen) if fits_broadcast(chosen) else chosen, "val", "left_semi")
    return candidates.groupBy("val").agg(F.count("*").alias("cnt")).orderBy(F.desc("cnt"), "val").limit(top)
