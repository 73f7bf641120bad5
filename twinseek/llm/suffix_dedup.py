"""Removal of repeated byte strings by merging Burrows-Wheeler transforms of shards.

Only windows whose least 16-byte gram (by hash) also is the least of a window of another text can repeat (`repeats`). Such windows are cut out as
short reads, one per run of windows with the same gram, and gathered by gram, so equal windows meet. In a task equal reads are one
entry with the smallest id; one that is then alone with its gram shares no window and is not merged. The task splits the other reads into
shards, sorts the suffixes of each shard alone and keeps its transform. The
transforms are merged without sorting suffixes again: an interleave of the rows of all shards is refined step by step. A refinement reads the
symbols that the transforms hold at the rows in the present order, deals the rows out by symbol, stably, and follows the transforms to
the rows in front, which orders the interleave by two more symbols. Only rows of suffixes that begin a whole window are kept in it.
After as many refinements as a window has symbols, neighbours that share a prefix of a whole window are the intervals of
repeated windows, and the smallest id of an interval decides.

A gram that very many texts have is not gathered in one task: its windows are grouped one by one, which says the same.

Copies of a whole text are one text: what is not the smallest id of its text loses every byte if it has a whole window.

Defined cases: a null text is empty; a text shorter than a window keeps all bytes; repeats inside one document, or between rows of
the same id, remove nothing; a null id counts as larger than any other and removes nothing; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinseek.llm import repeats
from twinseek.llm.common import joined_bytes, mixed, pieces, stored, whole_text
from twinseek.llm.substring_dedup import BASE, Rolling, covered

WINDOW, GRAM = 50, 16
# Bytes of reads merged at once in a task, and bytes of one shard of them.
MERGED_BYTES, SHARD_BYTES = 1 << 19, 1 << 16
# Texts with one gram above which its windows are grouped one by one.
CROWDED = 20_000
# A byte that no UTF-8 text holds ends a read.
END = 0xFF
NO_ID = np.iinfo(np.int64).max


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of every `width` values in a row."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def window_grams(buffer: np.ndarray, offsets: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every window of joined texts its text, first byte and least gram."""
    n = len(buffer)
    sizes = np.diff(offsets)
    of = np.repeat(np.arange(len(sizes)), np.maximum(sizes - window + 1, 0))
    if not len(of):
        return of, of, np.zeros(0, np.uint64)
    heads = np.cumsum(np.maximum(sizes - window + 1, 0)) - np.maximum(sizes - window + 1, 0)
    starts = np.arange(len(of)) - heads[of] + offsets[:-1][of]
    gram = min(GRAM, window)
    letters = mixed(np.arange(1, 257, dtype=np.uint64) * BASE[0])[buffer]
    places = np.arange(n - gram + 1)
    grams = Rolling(letters, BASE[0]).of(places, places + gram)
    return of, starts, sliding_least(grams, window - gram + 1)[starts]


def _keys_of(window: int):
    def keys(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        of, _, key = window_grams(*joined_bytes(texts), window)
        change = np.r_[True, (key[1:] != key[:-1]) | (of[1:] != of[:-1])] if len(key) else np.zeros(0, bool)
        return of[change], key[change]

    return keys


def _cut(batches: Iterator[pa.RecordBatch], window: int, wanted: Callable[[np.ndarray], np.ndarray]):
    """Of each piece its columns, joined bytes, and the wanted windows: text, first byte, gram."""
    for batch in batches:
        for part in pieces(batch, "text", repeats.PIECE):
            buffer, offsets = joined_bytes(part.column("text"))
            of, starts, key = window_grams(buffer, offsets, window)
            keep = wanted(key)
            if keep.any():
                yield part, buffer, offsets, of[keep], starts[keep], key[keep]


def _reads(window: int, shared: Broadcast, crowded: Broadcast):
    """Runs of windows with one shared gram: gram, text, id, place of the first window, bytes."""
    most = window - min(GRAM, window) + 1

    def wanted(key: np.ndarray) -> np.ndarray:
        return repeats.maybe_in(shared.value, key) & ~repeats.maybe_in(crowded.value, key)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, buffer, offsets, of, starts, key in _cut(batches, window, wanted):
            new = np.r_[True, (key[1:] != key[:-1]) | (starts[1:] != starts[:-1] + 1) | (of[1:] != of[:-1])]
            run = np.flatnonzero(new)[np.cumsum(new) - 1]
            heads = np.flatnonzero((np.arange(len(of)) - run) % most == 0)
            tails = np.r_[heads[1:], len(of)] - 1
            data = buffer.tobytes()
            spans = zip(starts[heads].tolist(), (starts[tails] + window).tolist(), strict=True)
            yield pa.record_batch(
                [
                    pa.array(key[heads].view(np.int64)),
                    *[part.column(c).take(pa.array(of[heads])) for c in ("d", "e", "doc_id")],
                    pa.array(starts[heads] - offsets[:-1][of[heads]]),
                    pa.array([data[a:b] for a, b in spans], pa.binary()),
                ],
                ["key", "d", "e", "doc_id", "place", "read"],
            )

    return cut


def _single(window: int, crowded: Broadcast):
    """Windows with a crowded gram, one by one: 128-bit name, text, id, place."""

    def wanted(key: np.ndarray) -> np.ndarray:
        return repeats.maybe_in(crowded.value, key)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, buffer, offsets, of, starts, _ in _cut(batches, window, wanted):
            names = []
            for base in BASE:
                letters = mixed(np.arange(1, 257, dtype=np.uint64) * base)[buffer]
                names.append(pa.array(Rolling(letters, base).of(starts, starts + window).view(np.int64)))
            own = [part.column(c).take(pa.array(of)) for c in ("d", "e", "doc_id")]
            yield pa.record_batch(
                [*names, *own, pa.array(starts - offsets[:-1][of])], ["one", "two", "d", "e", "doc_id", "place"]
            )

    return cut


def packed(text: np.ndarray, n: int) -> np.ndarray:
    """Eight bytes from each of the first n places on as one number that orders like them; the text is read as a ring."""
    ring = np.resize(text, n + 7).astype(np.uint64)
    two = ring[:-1] << np.uint64(8) | ring[1:]
    four = two[:-2] << np.uint64(16) | two[2:]
    return four[:-4] << np.uint64(32) | four[4:]


def suffix_order(text: np.ndarray, window: int) -> np.ndarray:
    """Suffixes of a shard (read as a ring) by their first `window` bytes.

    Ranks by one length and by the same length further on give ranks by both together, so lengths double. Ranks of a shard of up to
    65,536 bytes are sorted by counting.
    """
    n = len(text)
    rank = text.astype(np.uint16)
    have, kind = 1, np.uint16 if n <= 1 << 16 else np.int64
    order = np.argsort(rank, kind="stable")
    while have < window:
        step = min(have, window - have)
        behind = np.roll(rank, -step)
        order = np.lexsort((behind, rank))
        first, second = rank[order], behind[order]
        new = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        rank = np.empty(n, kind)
        rank[order] = np.r_[0, np.cumsum(new)]
        have += step
    return order


def merge(shards: list[np.ndarray], window: int, starts: np.ndarray) -> np.ndarray:
    """The windows at `starts` (places in the joined shards) in merged order.

    A window stands at the row behind its last byte at first. A refinement reads, for all windows in the present order, the two symbols
    that the transform of their shard has at their rows, deals the windows out by them, stably, and steps to the rows of the
    suffixes that begin there (the last-to-first mapping). An odd window takes one step of one symbol first.
    """
    sizes = np.array([len(s) for s in shards])
    bases = np.cumsum(sizes) - sizes
    places = np.concatenate([suffix_order(s, window) + b for s, b in zip(shards, bases, strict=True)])
    text = np.concatenate(shards).astype(np.uint16)
    n = len(text)
    row = np.empty(n, np.int32)
    row[places] = np.arange(n, dtype=np.int32)
    before = np.arange(n) - 1
    before[bases] = bases + sizes - 1
    # by row: symbols in front of the suffix, and the row of the suffix that begins with them
    one, one_back = text[before[places]], row[before[places]]
    second = before[before[places]]
    two, two_back = text[second] << np.uint16(8) | one, row[second]
    rows = row[starts + window]
    for symbols, back in [(one, one_back)] * (window % 2) + [(two, two_back)] * (window // 2):
        rows = rows[np.argsort(symbols[rows], kind="stable")]
        rows = back[rows]
    return places[rows]


def common_prefixes(text: np.ndarray, places: np.ndarray, window: int) -> np.ndarray:
    """Bytes, up to `window`, that each of the ordered windows shares with the one before; 0 for the first."""
    eight = packed(text, len(text))
    prefix = np.zeros(len(places), np.int64)
    alike = np.ones(max(len(places) - 1, 0), bool)
    for i in range(0, window, 8):
        column = eight[np.minimum(places + i, len(text) - 1)]
        apart = column[1:] ^ column[:-1]
        for byte in range(min(8, window - i)):
            alike &= apart >> np.uint64(56 - 8 * byte) == 0
            prefix[1:] += alike
    return prefix


def repeated(
    reads: list[bytes], least: np.ndarray, window: int, shard_bytes: int = SHARD_BYTES
) -> tuple[np.ndarray, np.ndarray]:
    """Number of a read and place in it, in order, of the windows that another read with a smaller id holds too."""
    shards, held, size = [], [], 0
    for read in reads:
        if held and size + len(read) + 1 > shard_bytes:
            shards.append(np.frombuffer(b"".join(held), np.uint8))
            held, size = [], 0
        held.append(read + bytes([END]))
        size += len(read) + 1
    shards.append(np.frombuffer(b"".join(held), np.uint8))
    lengths = np.array([len(r) + 1 for r in reads])
    begins = np.cumsum(lengths) - lengths
    windows = lengths - window
    of = np.repeat(np.arange(len(reads)), windows)
    starts = np.arange(len(of)) - (np.cumsum(windows) - windows)[of] + begins[of]
    places = merge(shards, window, starts)
    intervals = np.flatnonzero(common_prefixes(np.concatenate(shards), places, window) < window)
    read = np.searchsorted(begins, places, "right") - 1
    ids = least[read]
    smallest = np.repeat(np.minimum.reduceat(ids, intervals), np.diff(np.r_[intervals, len(ids)]))
    gone = np.flatnonzero(smallest < ids)
    at = np.sort(places[gone])
    read = np.searchsorted(begins, at, "right") - 1
    return read, at - begins[read]


def _judged(window: int):
    """Places of each read whose window a smaller id holds too. Reads come in the order of their grams."""

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, last = 0, None

        def flushed() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            coded = table.column("read").combine_chunks().dictionary_encode()
            of = coded.indices.to_numpy()
            n = len(coded.dictionary)
            ids = table.column("doc_id").cast(pa.int64()).fill_null(NO_ID).to_numpy()
            least = np.full(n, NO_ID)
            np.minimum.at(least, of, ids)
            # equal reads are one; a read that is alone with its gram then has no other to share a window with
            gram = np.zeros(n, np.int64)
            gram[of] = table.column("key").to_numpy()
            _, number, count = np.unique(gram, return_inverse=True, return_counts=True)
            met = np.flatnonzero(count[number] > 1)
            read = place = np.zeros(0, np.int64)
            if len(met):
                read, place = repeated(coded.dictionary.take(pa.array(met)).to_pylist(), least[met], window)
                read = met[read]
            # the first and last of a row of windows cover the same bytes, as a read has fewer windows than a window bytes
            starts = np.r_[True, (read[1:] != read[:-1]) | (place[1:] != place[:-1] + 1)][: len(read)]
            ends = np.r_[starts[1:], True][: len(read)]
            read, place = read[starts | ends], place[starts | ends]
            last = np.asarray(pc.binary_length(coded.dictionary)).astype(np.int64) - window
            # places to hand on of each row: first and last of a read whose every window a smaller id has, else what was found
            later = ids > least[of]
            found = np.bincount(read, minlength=n)
            sizes = np.where(later, np.where(last[of] > 0, 2, 1), found[of])
            row = np.repeat(np.arange(len(of)), sizes)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            begins = np.cumsum(found) - found
            at = np.zeros(len(row), np.int64)
            whole = later[row]
            at[whole] = np.where(nth[whole] == 0, 0, last[of[row[whole]]])
            at[~whole] = place[begins[of[row[~whole]]] + nth[~whole]]
            at += table.column("place").to_numpy()[row]
            rows = np.flatnonzero(sizes)
            places = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes[rows])].astype(np.int32)), pa.array(at))
            own = [table.column(c).combine_chunks().take(pa.array(rows)) for c in ("d", "e", "doc_id")]
            return pa.record_batch([*own, places], ["d", "e", "doc_id", "places"])

        for batch in batches:
            key = batch.column("key").to_numpy(zero_copy_only=False)
            if not len(key):
                continue
            new = np.r_[key[0] != last, key[1:] != key[:-1]]
            last = key[-1]
            ends = np.cumsum(np.asarray(pc.binary_length(batch.column("read"))).astype(np.int64))
            begin = 0
            for at in np.flatnonzero(new).tolist():
                # flush where a new gram begins, so that no gram is parted
                done = int(ends[at - 1] if at else 0) - int(ends[begin - 1] if begin else 0)
                if size + done >= MERGED_BYTES:
                    held.append(batch.slice(begin, at - begin))
                    yield flushed()
                    held, size, begin = [], 0, at
            held.append(batch.slice(begin))
            size += int(ends[-1]) - int(ends[begin - 1] if begin else 0)
        if size:
            yield flushed()

    return judged


def gone_places(docs: DataFrame, window: int = WINDOW, crowded: int = CROWDED) -> DataFrame:
    """d, e, places: begins of the windows of a text that a document with a smaller id than the text's has too."""
    texts = docs.select("doc_id", *repeats.digests(), whole_text().alias("text"))
    shared = repeats.shared(texts, _keys_of(window))
    heavy = shared.filter(F.col("n") > crowded)
    usual_table, heavy_table = repeats.bit_table(shared, "key"), repeats.bit_table(heavy, "key")
    own = f"d long, e long, doc_id {docs.schema['doc_id'].dataType.simpleString()}"
    reads = texts.mapInArrow(_reads(window, usual_table, heavy_table), f"key long, {own}, place long, read binary")
    gone = reads.repartition("key").sortWithinPartitions("key").mapInArrow(_judged(window), f"{own}, places array<long>")
    if not heavy.isEmpty():
        single = texts.mapInArrow(_single(window, heavy_table), f"one long, two long, {own}, place long")
        single = stored(single, "crowded-windows")
        least = stored(single.groupBy("one", "two").agg(F.min("doc_id").alias("least")), "least-ids")
        later = F.col("least").isNotNull() & (F.col("doc_id").isNull() | (F.col("doc_id") > F.col("least")))
        more = single.join(least, ["one", "two"]).filter(later).select("d", "e", "doc_id", F.array("place").alias("places"))
        gone = gone.unionByName(more)
    # of the copies of a text only the smallest id is judged by its windows; the others lose everything
    return (
        gone.groupBy("d", "e", "doc_id")
        .agg(F.flatten(F.collect_list("places")).alias("places"))
        .join(repeats.classes(docs), ["d", "e"])
        .filter(F.col("doc_id").eqNullSafe(F.col("least")))
        .select("d", "e", "places")
    )


def _kept_bytes(window: int):
    def kept(texts: pa.Array, places: pa.Array) -> pa.Array:
        out = []
        for text, gone in zip(texts.to_pylist(), places.to_pylist(), strict=True):
            data = np.frombuffer((text or "").encode(), np.uint8)
            removed = covered(np.array(gone or [], np.int64), window, len(data))
            spans = int(np.count_nonzero(removed & ~np.r_[False, removed[:-1]])) if len(data) else 0
            out.append((len(data), int(removed.sum()), spans, hashlib.sha256(data[~removed].tobytes()).hexdigest()))
        names = ("n_bytes", "n_removed", "n_spans", "kept_sha256")
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
        return pa.StructArray.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names)

    return kept


def kept_bytes(text: Column, places: Column, window: int = WINDOW) -> Column:
    """n_bytes, n_removed, n_spans and digest of the kept bytes, where windows begin at `places`."""
    kind = "struct<n_bytes:long,n_removed:long,n_spans:long,kept_sha256:string>"
    return F.arrow_udf(_kept_bytes(window), kind)(text, places)


def dedup(docs: DataFrame, window: int = WINDOW, crowded: int = CROWDED) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row of (doc_id, text)."""

    def measured(text: Column, places: Column) -> Column:
        return kept_bytes(text, places, window)

    whole, emptied = F.col("whole.n_bytes"), F.col("emptied")
    return repeats.settled(docs, gone_places(docs, window, crowded), measured, whole >= window).select(
        "doc_id",
        whole.alias("n_bytes"),
        F.when(emptied, whole).otherwise(F.coalesce("changed.n_removed", F.lit(0))).alias("n_removed"),
        F.when(emptied, F.lit(1)).otherwise(F.coalesce("changed.n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(emptied, F.sha2(F.lit(""), 256))
        .otherwise(F.coalesce("changed.kept_sha256", "whole.kept_sha256"))
        .alias("kept_sha256"),
    )
