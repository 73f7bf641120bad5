"""Texts that share passages with other texts, found through content-defined keys.

An operator names, for every window of a text, one key that depends on the window's content alone. Windows that are equal have equal keys,
so only windows whose key occurs in two different texts can repeat. Copies of a whole text are one text here: texts are known by a
128-bit digest (d, e), and the smallest id of each digest stands for it.

Keys are aggregated in the task that makes them, then by shuffle; what comes back to the texts is first tried against a bit
table of fixed size, so its size does not follow the corpus; the join after it is exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinseek.llm.common import pieces, stored, whole_text

# Of the texts of a piece: which text each key is from, and the keys (one entry per text and key, or more).
Keys = Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]
# Bytes of text that are looked at together, and keys that a task aggregates before it passes them on.
PIECE, HELD_KEYS = 1 << 19, 1 << 21
# Bits of a table, and bits of one page of it. The table is 16 MB whatever the corpus.
TABLE_BITS, PAGE_BITS = 27, 16


def digests() -> list[Column]:
    """128 bits of a text as two numbers."""
    text = whole_text()
    return [F.xxhash64(text).alias("d"), F.xxhash64(F.lit(1), text).alias("e")]


def classes(docs: DataFrame) -> DataFrame:
    """d, e, least: each different text with the smallest id that has it (null: only null ids have it)."""
    return docs.select("doc_id", *digests()).groupBy("d", "e").agg(F.min("doc_id").alias("least"))


def _distinct(text: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((text, key))
    text, key = text[order], key[order]
    first = np.r_[True, (key[1:] != key[:-1]) | (text[1:] != text[:-1])] if len(key) else np.zeros(0, bool)
    return text[first], key[first]


def _made(batches: Iterator[pa.RecordBatch], keys_of: Keys) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(digest, key) of all keys, piece by piece."""
    for batch in batches:
        for part in pieces(batch, "text", PIECE):
            d = part.column("d").to_numpy(zero_copy_only=False)
            text, key = _distinct(*keys_of(part.column("text")))
            yield d[text], key


def _ranges(keys_of: Keys):
    """For each key the least and greatest digest that a task saw it in, and in how many texts."""

    def flushed(held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        d, key = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((d, key))
        d, key = d[order], key[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        last = np.r_[first[1:], len(key)] - 1
        for i in range(0, len(first), 1 << 16):
            a, b = first[i : i + (1 << 16)], last[i : i + (1 << 16)]
            columns = [pa.array(key[a].view(np.int64)), pa.array(d[a]), pa.array(d[b]), pa.array(b - a + 1)]
            yield pa.record_batch(columns, ["key", "low", "high", "n"])

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for d, key in _made(batches, keys_of):
            held.append((d, key))
            size += len(key)
            if size >= HELD_KEYS:
                yield from flushed(held)
                held, size = [], 0
        if size:
            yield from flushed(held)

    return made


def bit_table(numbers: DataFrame, column: str) -> Broadcast:
    """A table of 2^27 bits with the bits of all numbers set; built page by page, at most 2,048 pages reach the driver."""
    slot = F.pmod(F.col(column), F.lit(1 << TABLE_BITS))
    paged = numbers.select(
        F.shiftright(slot, PAGE_BITS).cast("int").alias("page"), slot.bitwiseAND((1 << PAGE_BITS) - 1).cast("int").alias("bit")
    ).distinct()

    def page(table: pa.Table) -> pa.Table:
        bits = np.zeros(1 << PAGE_BITS, np.uint8)
        bits[table.column("bit").to_numpy()] = 1
        return pa.table({"page": table.column("page").slice(0, 1), "bits": [np.packbits(bits).tobytes()]})

    table = np.zeros((1 << (TABLE_BITS - PAGE_BITS), 1 << (PAGE_BITS - 3)), np.uint8)
    for row in paged.groupBy("page").applyInArrow(page, "page int, bits binary").collect():
        table[row["page"]] = np.frombuffer(row["bits"], np.uint8)
    return numbers.sparkSession.sparkContext.broadcast(table.ravel())


def maybe_in(table: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    slot = numbers.view(np.uint64) & np.uint64((1 << TABLE_BITS) - 1)
    return (table[slot >> np.uint64(3)] >> (np.uint8(7) - (slot & np.uint64(7)).astype(np.uint8))) & 1 == 1


def _asked(keys_of: Keys, table: Broadcast):
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for d, key in _made(batches, keys_of):
            keep = maybe_in(table.value, key)
            if keep.any():
                yield pa.record_batch([pa.array(key[keep].view(np.int64)), pa.array(d[keep])], ["key", "d"])

    return made


def _with_digest(table: Broadcast):
    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = maybe_in(table.value, batch.column("d").to_numpy(zero_copy_only=False))
            if keep.any():
                yield batch.filter(pa.array(keep))

    return kept


def shared_keys(keys: pa.Array, text: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Which of the windows (their text, in order, and key) have a key that their text shares."""
    offsets = keys.offsets.to_numpy()
    pairs = keys.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    keep = np.zeros(len(key), bool)
    for i in np.unique(text).tolist():
        mine = slice(*np.searchsorted(text, [i, i + 1]))
        keep[mine] = np.isin(key[mine], pairs[offsets[i] - offsets[0] : offsets[i + 1] - offsets[0]])
    return keep


def shared(texts: DataFrame, keys_of: Keys) -> DataFrame:
    """key, n: the keys that two different texts of (d, text) have, and how many rows have them."""
    ranges = texts.select("d", "text").mapInArrow(_ranges(keys_of), "key long, low long, high long, n long")
    total = ranges.groupBy("key").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n"))
    return stored(total.filter(F.col("low") != F.col("high")).select("key", "n"), "shared-keys")


def sharing_texts(docs: DataFrame, keys_of: Keys) -> DataFrame:
    """d, e, least, text, keys: every text that has a key which another text has too, once, with all such keys of it."""
    texts = docs.select(*digests(), whole_text().alias("text"))
    common = shared(texts, keys_of)
    asked = texts.select("d", "text").mapInArrow(_asked(keys_of, bit_table(common, "key")), "key long, d long")
    found = stored(asked.join(common.select("key"), "key").select("d", "key").distinct(), "found-keys")
    near = texts.mapInArrow(_with_digest(bit_table(found, "d")), "d long, e long, text string").dropDuplicates(["d", "e"])
    keys = found.groupBy("d").agg(F.collect_list("key").alias("keys"))
    # the small sides are joined first, so that the texts are dealt out once
    known = keys.join(classes(docs), "d")
    return stored(near.join(known, ["d", "e"]).select("d", "e", "least", "text", "keys"), "sharing-texts")


def settled(
    docs: DataFrame, gone: DataFrame, measured: Callable[[Column, Column], Column], has_window: Column
) -> DataFrame:
    """doc_id, whole, changed, emptied of each row of (doc_id, text).

    `measured` describes a text from which the windows at some places are taken; `whole` is that without any, `changed` that with the
    places in `gone` (null where none), `emptied` says that the row is a copy of a text with a smaller id and has a window.
    """
    gone = stored(gone, "gone-places")
    texts = docs.select(*digests(), whole_text().alias("text"))
    near = texts.mapInArrow(_with_digest(bit_table(gone, "d")), "d long, e long, text string").dropDuplicates(["d", "e"])
    changed = stored(
        near.join(gone, ["d", "e"]).select("d", "e", measured(F.col("text"), F.col("places")).alias("changed")), "changed"
    )
    none = F.array().cast("array<long>")
    rows = stored(docs.select("doc_id", *digests(), measured(F.col("text"), none).alias("whole")), "rows")
    of = rows.groupBy("d", "e").agg(F.min("doc_id").alias("least")).join(changed, ["d", "e"], "left")
    copy = F.col("least").isNotNull() & (F.col("doc_id").isNull() | (F.col("doc_id") > F.col("least")))
    return rows.join(stored(of, "classes"), ["d", "e"]).select(
        "doc_id", "whole", "changed", (copy & has_window).alias("emptied")
    )
