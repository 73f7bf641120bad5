"""Removal of repeated runs of words, found by recompression.

A text is a sequence of word names. A round replaces every run of one symbol by a symbol for (symbol, length), then every pair of
a left and a right symbol by a symbol for the pair; which symbols are left and right is drawn from their names. Names are hashes of
what they stand for, so all tasks give equal runs and pairs the same name in every round without a dictionary to keep in step. A
symbol's surroundings decide only where it begins and ends; each symbol carries the range of words that decided it. If
this range lies inside a window of words, every equal window in the corpus holds the same symbol at the same place.

Words are named by 128 bits of their bytes. Each window takes, of the symbols of the highest round it holds with their ranges, the one
with the least key; a symbol's key is its name together with the words of its range. A window without any is its own key. Keys that two texts share reveal the windows that may
repeat (`repeats`); these are verified by a 128-bit name of all their words, grouped for the smallest id.

Copies of a whole text are one text: what is not the smallest id of its text loses every word if it has a whole window.

Defined cases: a null text has no words; a text shorter than a window keeps all words; repeats inside one document, or between
rows of the same id, remove nothing; a null id counts as larger than any other and removes nothing; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from twinseek.llm import repeats
from twinseek.llm.common import joined_bytes, mixed, pieces, stored, word_bounds

WINDOW = 50
ROUNDS = 4
# Odd multipliers of the rolling names; a second one makes names of 128 bits.
BASE = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
STEP = np.uint64(0xD6E8FEB86659FD93)
# What is added to a name to draw its side in a round.
DRAWS = mixed(np.arange(1, 17, dtype=np.uint64) * STEP)


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base^0 ... base^(n-1) modulo 2^64."""
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def inverse(base: np.uint64) -> np.uint64:
    return np.uint64(pow(int(base), -1, 1 << 64))


class Rolling:
    """Names of any range of a sequence of numbers, from prefix sums."""

    def __init__(self, numbers: np.ndarray, base: np.uint64):
        n = len(numbers)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(numbers * powers(base, n), out=self.sums[1:])
        self.back = powers(inverse(base), n + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.back[start])


def word_names(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that name each word by its bytes, as two numbers; a word is hashed once for all its places."""
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=offsets[1:])
    inside = np.zeros(len(buffer) + 1, np.int8)
    inside[starts] = 1
    inside[ends] -= 1
    letters = buffer[np.cumsum(inside[:-1], dtype=np.int8) > 0]
    kept = [pa.py_buffer(x) for x in (offsets, letters)]
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, *kept]).dictionary_encode()
    digests = b"".join([xxh3_128_digest(w) for w in words.dictionary.to_pylist()])
    names = np.frombuffer(digests, np.uint64).reshape(-1, 2)[words.indices.to_numpy()]
    return np.ascontiguousarray(names[:, 0]), np.ascontiguousarray(names[:, 1])


class Symbols:
    """One round's symbols over joined texts: name, text, and the words [low, high) that decided them."""

    def __init__(self, names: np.ndarray, text: np.ndarray, first: np.ndarray, end: np.ndarray):
        places = np.arange(len(names))
        self.name, self.text, self.low, self.high = names, text, places, places + 1
        # one before the first word and one behind the last word of each text stand for what is not known there
        self.before, self.behind = first - 1, end + 1

    def neighbours(self) -> tuple[np.ndarray, np.ndarray]:
        """The range that also takes in the symbol before, and the symbol behind."""
        same = self.text[1:] == self.text[:-1]
        low = np.r_[self.before[self.text[:1]], np.where(same, self.low[:-1], self.before[self.text[1:]])]
        high = np.r_[np.where(same, self.high[1:], self.behind[self.text[:-1]]), self.behind[self.text[-1:]]]
        return low, high

    def join_runs(self) -> None:
        low, high = self.neighbours()
        heads = np.flatnonzero(np.r_[True, (self.name[1:] != self.name[:-1]) | (self.text[1:] != self.text[:-1])])
        tails = np.r_[heads[1:], len(self.name)] - 1
        length = (tails - heads + 1).astype(np.uint64)
        name = self.name[heads]
        name = np.where(length > 1, mixed(name * STEP + length), name)
        self.name, self.text, self.low, self.high = name, self.text[heads], low[heads], high[tails]

    def join_pairs(self, round_: int) -> None:
        right = mixed(self.name + DRAWS[round_]) & np.uint64(1) == 1
        low, high = self.neighbours()
        n = len(self.name)
        joins = np.zeros(n, bool)
        joins[:-1] = ~right[:-1] & right[1:] & (self.text[1:] == self.text[:-1])
        second = np.zeros(n, bool)
        second[1:] = joins[:-1]
        at = np.flatnonzero(joins)
        name = self.name.copy()
        name[at] = mixed(self.name[at] * STEP + mixed(self.name[at + 1]))
        # a left symbol that stayed alone saw its right neighbour, a right symbol its left one
        own_low = np.where(right & ~second, low, self.low)
        own_high = np.where(~right & ~joins, high, self.high)
        own_high[at] = self.high[at + 1]
        keep = ~second
        self.name, self.text, self.low, self.high = name[keep], self.text[keep], own_low[keep], own_high[keep]


def least_in(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Least value of each range [low, high), none of them empty."""
    width = high - low
    level = np.frexp(width.astype(np.float64))[1] - 1
    out = np.empty(len(low), values.dtype)
    table = values
    for step in range(int(level.max()) + 1 if len(level) else 0):
        at = np.flatnonzero(level == step)
        out[at] = np.minimum(table[low[at]], table[high[at] - (1 << step)])
        table = np.minimum(table[: -(1 << step) or None], table[1 << step :])
    return out


def window_keys(
    names: np.ndarray, counts: np.ndarray, window: int = WINDOW, rounds: int = ROUNDS
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every window of joined texts its text, first word (counted over all texts) and key."""
    end = np.cumsum(counts)
    first = end - counts
    text = np.repeat(np.arange(len(counts)), counts)
    starts = np.flatnonzero(np.arange(len(names)) + window <= end[text]) if len(names) else np.zeros(0, np.int64)
    of = text[starts]
    if not len(starts):
        return of, starts, np.zeros(0, np.uint64)
    rolling = Rolling(names, BASE[0])
    levels = []
    symbols = Symbols(names, text, first, end)
    for round_ in range(rounds):
        symbols.join_runs()
        symbols.join_pairs(round_)
        levels.append((symbols.low, symbols.high, symbols.name))
    keys = np.zeros(len(starts), np.uint64)
    open_ = np.arange(len(starts))
    for level in range(rounds - 1, -1, -1):
        low, high, name = levels[level]
        inside = high - low <= window
        low, high = low[inside], high[inside]
        known = (low >= 0) & (high <= len(names))
        value = np.full(len(low), ~np.uint64(0))
        value[known] = mixed(name[inside][known] ^ rolling.of(low[known], high[known]))
        begin = np.searchsorted(low, starts[open_], "left")
        stop = np.searchsorted(high, starts[open_] + window, "right")
        some = stop > begin
        keys[open_[some]] = least_in(value, begin[some], stop[some])
        open_ = open_[~some]
        if not len(open_):
            return of, starts, keys
    keys[open_] = rolling.of(starts[open_], starts[open_] + window)
    return of, starts, keys


def _named(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    buffer, offsets = joined_bytes(texts)
    starts, ends, counts = word_bounds(buffer, offsets)
    return *word_names(buffer, starts, ends), counts


def _keys_of(window: int):
    def keys(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        names, _, counts = _named(texts)
        of, _, key = window_keys(names, counts, window)
        change = np.r_[True, (key[1:] != key[:-1]) | (of[1:] != of[:-1])] if len(key) else np.zeros(0, bool)
        return of[change], key[change]

    return keys


def _windows(window: int):
    """Windows of sharing texts whose key is shared: 128-bit name, text, place."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text", repeats.PIECE):
                names, other, counts = _named(part.column("text"))
                of, starts, key = window_keys(names, counts, window)
                keep = repeats.shared_keys(part.column("keys"), of, key)
                of, starts = of[keep], starts[keep]
                ends = starts + window
                one, two = (Rolling(n, b).of(starts, ends) for n, b in zip((names, other), BASE, strict=True))
                place = starts - (np.cumsum(counts) - counts)[of]
                own = [part.column(c).take(pa.array(of)) for c in ("d", "e", "least")]
                yield pa.record_batch(
                    [pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), *own, pa.array(place)],
                    ["one", "two", "d", "e", "least", "place"],
                )

    return made


def covered(places: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of n units some window [place, place + width) covers."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, places, 1)
    np.add.at(edges, np.minimum(places + width, n), -1)
    return np.cumsum(edges)[:n] > 0


def _kept_words(window: int):
    def kept(texts: pa.Array, places: pa.Array) -> pa.Array:
        out = []
        for text, gone in zip(texts.to_pylist(), places.to_pylist(), strict=True):
            words = (text or "").encode().split()
            removed = covered(np.array(gone or [], np.int64), window, len(words))
            left = b" ".join([w for w, r in zip(words, removed.tolist(), strict=True) if not r])
            out.append((len(words), int(removed.sum()), hashlib.sha256(left).hexdigest()))
        names, kinds = ("n_words", "n_removed", "kept_sha256"), (pa.int64(), pa.int64(), pa.string())
        return pa.StructArray.from_arrays(
            [pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names
        )

    return kept


def kept_words(text: Column, places: Column, window: int = WINDOW) -> Column:
    """n_words, n_removed and digest of the kept words, where windows begin at `places`."""
    kind = "struct<n_words:long,n_removed:long,kept_sha256:string>"
    return F.arrow_udf(_kept_words(window), kind)(text, places)


def gone_places(texts: DataFrame, window: int = WINDOW) -> DataFrame:
    """d, e, places: begins of the windows of a sharing text that a document with a smaller id than the text's has too."""
    id_type = texts.schema["least"].dataType.simpleString()
    schema = f"one long, two long, d long, e long, least {id_type}, place long"
    windows = stored(texts.mapInArrow(_windows(window), schema), "windows")
    # only windows that a later document has too; stored, so that the join reads two plain exchanges and a window that very many
    # documents have can be split at run time
    first = windows.groupBy("one", "two").agg(
        F.min("least").alias("first"), F.max("least").alias("last"), F.bool_or(F.col("least").isNull()).alias("unnumbered")
    )
    first = first.filter((F.col("last") > F.col("first")) | (F.col("unnumbered") & F.col("first").isNotNull()))
    first = stored(first.select("one", "two", "first"), "first-windows")
    later = F.col("least").isNull() | (F.col("least") > F.col("first"))
    gone = windows.join(first, ["one", "two"]).filter(later)
    return gone.groupBy("d", "e").agg(F.collect_list("place").alias("places"))


def dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of each row of (doc_id, text)."""
    texts = repeats.sharing_texts(docs, _keys_of(window))

    def measured(text: Column, places: Column) -> Column:
        return kept_words(text, places, window)

    whole = F.col("whole.n_words")
    return repeats.settled(docs, gone_places(texts, window), measured, whole >= window).select(
        "doc_id",
        whole.alias("n_words"),
        F.when(F.col("emptied"), whole).otherwise(F.coalesce("changed.n_removed", F.lit(0))).alias("n_removed"),
        F.when(F.col("emptied"), F.sha2(F.lit(""), 256))
        .otherwise(F.coalesce("changed.kept_sha256", "whole.kept_sha256"))
        .alias("kept_sha256"),
    )
