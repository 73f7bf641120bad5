"""Vector literals, dimension checks and the inner-product distance."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: width of the embeddings the engine was designed around.
DEFAULT_DIMENSION = 768


def parse_vector(literal: Column) -> Column:
    """`[0.1,0.2,]` to an array of floats; empty items are ignored."""
    items = F.split(F.regexp_replace(literal, r"[\[\]\s]", ""), ",")
    return F.transform(F.filter(items, lambda x: x != ""), lambda x: x.cast("float"))


def format_vector(vector: Column) -> Column:
    """Array of numbers to its text literal, for export only."""
    return F.concat(F.lit("["), F.array_join(F.transform(vector, lambda x: x.cast("string")), ","), F.lit("]"))


def vector_literal(values) -> Column:
    """A query vector from Python as an `array<float>` column."""
    return F.lit([float(v) for v in values]).cast("array<float>")


def require_dimension(vector: Column, dimension: int) -> Column:
    """The vector itself, or a job failure when its width is wrong. Null stays null."""
    wrong = F.concat(F.lit(f"expected {dimension} dimensions, not "), F.size(vector).cast("string"))
    return F.when(vector.isNotNull() & (F.size(vector) != dimension), F.raise_error(wrong)).otherwise(vector)


def inner_product(a: Column, b: Column) -> Column:
    """Sum of products in double precision. Null when a vector is null or the widths differ."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def negative_inner_product(a: Column, b: Column) -> Column:
    """Distance used for ranking: smaller is nearer."""
    return -inner_product(a, b)
