"""Row numbers, top-k and order statistics that never put an unbounded group into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Fixed values of the percentile rule: 1-based rank int(n * p), at least 1; p99 is the maximum below this many rows.
P99_MIN_ROWS = 100
# One-dimensional splits per order statistic; blocks hold about 1/SPLITS of the distinct values.
SPLITS = 256


def ranked_sort(column: str, descending: bool = False) -> Column:
    """Nulls last whatever the direction."""
    return F.col(column).desc_nulls_last() if descending else F.col(column).asc_nulls_last()


def top_k(df: DataFrame, score: str, k: int, tie: str = "id", descending: bool = False) -> DataFrame:
    """Best k rows of the whole input, ties by id (plans as a distributed take-ordered)."""
    return df.orderBy(ranked_sort(score, descending), F.col(tie)).limit(k)


def top_k_per_query(
    df: DataFrame,
    score: str,
    k: int | Column,
    by: Sequence[str] = ("query_id",),
    tie: str = "id",
    descending: bool = False,
    rank: str = "rank",
) -> DataFrame:
    """Rank within each query and keep ranks up to k.

    With a literal k Spark limits each task's rows before the shuffle, so a query never brings more than k rows per task.
    """
    w = Window.partitionBy(*by).orderBy(ranked_sort(score, descending), F.col(tie))
    k = k if isinstance(k, Column) else F.lit(k)
    return df.withColumn(rank, F.row_number().over(w).cast("long")).filter(F.col(rank) <= k)


def blocked_row_number(
    df: DataFrame,
    order: Sequence[Column],
    block: Column,
    by: Sequence[str] = (),
    out: str = "row_number",
    total: str | None = None,
) -> DataFrame:
    """1-based row number in each group of `by` (or overall), group of any size.

    `block` must grow with the order: every row of a lower block sorts before every row of a higher one. Rows are numbered
    inside (group, block); the counts of the lower blocks, one small row per (group, block), are added. A group that holds a
    third of the table is thus spread over as many tasks as it has blocks.
    """
    keys = [*by, "__block"]
    tagged = df.withColumn("__block", block)
    local = tagged.withColumn("__local", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))
    counts = tagged.groupBy(*keys).agg(F.count("*").alias("__n"))
    lower = Window.partitionBy(*(by or [F.lit(0)])).orderBy("__block")
    before = counts.select(
        *keys,
        F.coalesce(
            F.sum("__n").over(lower.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("__before"),
        F.sum("__n").over(Window.partitionBy(*(by or [F.lit(0)]))).alias("__total"),
    )
    joined = local.join(before, [F.equal_null(local[c], before[c]) for c in keys], "inner")
    result = joined.select(
        *[local[c] for c in df.columns],
        (local["__local"] + before["__before"]).alias(out),
        *([before["__total"].alias(total)] if total else []),
    )
    return result


def hash_order(column: str, seed: int = 0) -> tuple[list[Column], Column]:
    """Repeatable shuffle order on a column with a block that follows it (the top bits of the hash)."""
    h = F.xxhash64(F.col(column), F.lit(seed))
    return [h, F.col(column)], F.shiftright(h, 52)


def order_statistics(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Per group: n, median, p95 and p99 by the fixed rank rule. Exact, and no group is gathered in one task.

    Equal values are counted first; distinct values are split at measured quantiles; running counts inside the splits and
    the totals of the lower splits give each value its range of ranks; the wanted ranks are then looked up.
    """
    values = df.filter(F.col(value).isNotNull())
    histogram = values.groupBy(*by, value).agg(F.count("*").alias("__n"))
    probabilities = [i / SPLITS for i in range(1, SPLITS)]
    cuts = sorted(set(histogram.approxQuantile(value, probabilities, 0.25 / SPLITS)))
    edges = [float("-inf"), *cuts, float("inf")]
    split = Bucketizer(splits=edges, inputCol=value, outputCol="__split").transform(
        histogram.withColumn(value, F.col(value).cast("double"))
    )
    keys = [*by, "__split"]
    inner = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    running = split.withColumn("__last", F.sum("__n").over(inner))
    per_split = split.groupBy(*keys).agg(F.sum("__n").alias("__m"))
    group = Window.partitionBy(*by)
    before = per_split.select(
        *keys,
        F.coalesce(
            F.sum("__m").over(group.orderBy("__split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("__before"),
        F.sum("__m").over(group).alias("__total"),
    )
    n = F.col("__total")
    high = F.col("__last") + F.col("__before")
    low = high - F.col("__n")

    def at(rank: Column) -> Column:
        return F.max(F.when((low < rank) & (rank <= high), F.col(value)))

    p95 = F.greatest(F.lit(1), F.floor(n * F.lit(0.95)))
    p99 = F.when(n >= P99_MIN_ROWS, F.floor(n * F.lit(0.99))).otherwise(n)
    return (
        running.join(before, keys)
        .groupBy(*by)
        .agg(
            F.max(n).alias("n"),
            ((at(F.floor((n + 1) / 2)) + at(F.ceil((n + 1) / 2))) / 2).alias("median"),
            at(p95).alias("p95"),
            at(p99).alias("p99"),
        )
    )
