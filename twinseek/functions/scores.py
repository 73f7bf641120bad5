"""Score arithmetic, always in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def reciprocal_rank(rank: Column, k: float | Column, missing_rank: int | None = None) -> Column:
    """1/(k+rank). A missing rank gives null, or counts as `missing_rank` when one is set."""
    if missing_rank is not None:
        rank = F.coalesce(rank, F.lit(missing_rank))
    k = k if isinstance(k, Column) else F.lit(float(k))
    return F.lit(1.0) / (k.cast("double") + rank.cast("double"))


def weighted(part: Column, weight: float | Column) -> Column:
    """A leg's contribution; a leg that did not return the row contributes zero."""
    weight = weight if isinstance(weight, Column) else F.lit(float(weight))
    return F.coalesce(part, F.lit(0.0)) * weight.cast("double")


def position_score(rank: Column) -> Column:
    """Score of a single-leg result: one over its 1-based position."""
    return F.lit(1.0) / rank.cast("double")


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def improvement_percent(before: Column, after: Column) -> Column:
    return F.try_divide((before - after).cast("double"), before.cast("double")) * F.lit(100.0)


def share_percent(part: Column, whole: Column) -> Column:
    return F.try_divide(part.cast("double"), whole.cast("double")) * F.lit(100.0)
