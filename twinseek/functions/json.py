"""Predicates on JSON metadata held as text."""

from __future__ import annotations

from functools import reduce
from operator import and_
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def _path(key: str) -> str:
    if "'" in key:
        raise ValueError(f"metadata key not supported in a path: {key!r}")
    return f"$['{key}']"


def json_text(meta: Column, key: str) -> Column:
    """Value of a key as text; null when the key is absent or holds JSON null."""
    return F.get_json_object(meta, _path(key))


def json_bool(meta: Column, key: str) -> Column:
    return json_text(meta, key).try_cast("boolean")


def json_double(meta: Column, key: str) -> Column:
    return json_text(meta, key).try_cast("double")


def json_default(value: Column, default: Any) -> Column:
    return F.coalesce(value, F.lit(default))


def json_has_key(meta: Column, key: str) -> Column:
    """True when the top-level key exists, also when its value is JSON null."""
    return F.coalesce(F.array_contains(F.json_object_keys(meta), key), F.lit(False))


def json_between(meta: Column, key: str, low: Column | float, high: Column | float) -> Column:
    low = low if isinstance(low, Column) else F.lit(float(low))
    high = high if isinstance(high, Column) else F.lit(float(high))
    return json_double(meta, key).between(low, high)


def json_contains(meta: Column, wanted: dict | list) -> Column:
    """Containment of a JSON value known on the driver: recursive, type-strict, arrays without order or duplicates.

    `{"a": 1}` is contained in `{"a": 1, "b": 2}` but not in `{"a": "1"}`. Null metadata gives null, as in SQL.
    """
    # the lambda holds the parsed value; as a plain expression it would be parsed again for every part of the condition
    held = F.element_at(F.transform(F.array(F.try_parse_json(meta)), lambda value: variant_contains(value, wanted)), 1)
    return F.when(meta.isNotNull(), held)


def variant_contains(value: Column, wanted: dict | list) -> Column:
    """The same for JSON that is a VARIANT already."""
    return F.coalesce(_contains(value, wanted), F.lit(False))


def _type(value: Column) -> Column:
    return F.schema_of_variant(value)


def _any_contains(items: Column, wanted: Any) -> Column:
    return F.exists(items, lambda x: F.coalesce(_contains(x, wanted), F.lit(False)))


def _contains(value: Column, wanted: Any) -> Column:
    if isinstance(wanted, dict):
        is_object = F.startswith(_type(value), F.lit("OBJECT"))
        parts = [_contains(F.try_variant_get(value, _path(k), "variant"), v) for k, v in wanted.items()]
        return reduce(and_, parts, is_object)
    if isinstance(wanted, (list, tuple)):
        is_array = F.startswith(_type(value), F.lit("ARRAY"))
        items = F.try_variant_get(value, "$", "array<variant>")
        parts = [_any_contains(items, w) for w in wanted]
        return reduce(and_, parts, is_array)
    if wanted is None:
        return _type(value) == "VOID"
    if isinstance(wanted, bool):
        return (_type(value) == "BOOLEAN") & (F.try_variant_get(value, "$", "boolean") == F.lit(wanted))
    if isinstance(wanted, (int, float)):
        number = F.rlike(_type(value), F.lit("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$"))
        return number & (F.try_variant_get(value, "$", "double") == F.lit(float(wanted)))
    return (_type(value) == "STRING") & (F.try_variant_get(value, "$", "string") == F.lit(str(wanted)))
