"""Near-duplicates by SimHash, found with a hierarchical index over fingerprints in Gray order.

Fingerprints that occur are reduced to the distinct ones first, so a group of copies is one entry. Two fingerprints that differ
in at most two bits agree in one of three blocks of bits: each is sent to three places, by block and block value. There the
entries are sorted by Gray rank, which puts fingerprints with long shared patterns side by side; runs of neighbours become
leaves, runs of leaves upper nodes. A node holds the bits in which all below agree (pattern and mask). The search walks pairs of
nodes from the top; the bits in which two patterns differ under both masks only add up on the way down, so a pair is dropped with
everything below it as soon as they are too many. Links are reduced to spanning trees where they are found, and components follow
from star contraction.

A block value that very many distinct fingerprints share is cut again: of the remaining bits, three sub-blocks, one of
which must agree as well. No link is lost.

Defined cases: a text without words (or null) has fingerprint zero and is linked like any other; a text of fewer words than a
shingle is one shingle; repeated rows share a component; null ids never become the smallest id; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from twinseek.llm import components
from twinseek.llm.common import stored, whole_text

SHINGLE = 3
SEED = 42
DISTANCE = 2
# Bits of the three blocks, from the top, and of the sub-blocks of a cut block.
BLOCKS = (22, 21, 21)
# Distinct fingerprints under one block value above which the value is cut again.
CUT_ABOVE = 100_000
FAN = 8
# Entries indexed at once, and node pairs walked at once, in one task.
INDEX_ROWS, WALK_PAIRS = 1 << 20, 1 << 13
COUNT_ROWS = 1 << 15


def fingerprint_of(text: str | None) -> int:
    """64-bit fingerprint: a bit is 1 if it is set in over half of the shingle hashes, repeats included."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = [e - 1 for e in accumulate(len(w) + 1 for w in words)]
    starts = [0, *[e + 1 for e in ends[:-1]]]
    width = min(SHINGLE, len(words))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(line[a:b], SEED) for a, b in zip(starts, ends[width - 1 :], strict=False)),
        np.uint64,
        len(words) - width + 1,
    )
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), COUNT_ROWS):
        octets = hashes[i : i + COUNT_ROWS].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(text: Column) -> Column:
    """Fingerprint as a signed 64-bit number."""

    def hashed(texts: pa.Array) -> pa.Array:
        values = np.array([fingerprint_of(t) for t in texts.to_pylist()], np.uint64)
        return pa.array(values.view(np.int64), pa.int64())

    return F.arrow_udf(hashed, "long")(text)


def rotated(codes: np.ndarray, left: int) -> np.ndarray:
    left %= 64
    return codes if left == 0 else (codes << np.uint64(left)) | (codes >> np.uint64(64 - left))


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Place of each code in the Gray sequence."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """Levels of (pattern, mask) nodes over codes sorted by Gray rank; level 0 is the codes themselves."""

    def __init__(self, codes: np.ndarray):
        self.patterns, self.masks = [codes], [np.full(len(codes), ~np.uint64(0))]
        while len(self.patterns[-1]) > 1:
            cuts = np.arange(0, len(self.patterns[-1]), FAN)
            pattern, mask = self.patterns[-1], self.masks[-1]
            ones = np.bitwise_and.reduceat(pattern & mask, cuts)
            zeros = np.bitwise_and.reduceat(~pattern & mask, cuts)
            self.patterns.append(ones)
            self.masks.append(ones | zeros)

    def pairs(self, distance: int, same: np.uint64) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of codes (i < j) within the distance that agree in all bits of `same`."""
        top = len(self.patterns) - 1
        stack = [(top, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        while stack:
            level, a, b = stack.pop()
            if len(a) > WALK_PAIRS:
                for i in range(0, len(a), WALK_PAIRS):
                    stack.append((level, a[i : i + WALK_PAIRS], b[i : i + WALK_PAIRS]))
                continue
            if level == 0:
                keep = a < b
                yield a[keep], b[keep]
                continue
            n = len(self.patterns[level - 1])
            steps = np.arange(FAN)
            left = np.repeat((a[:, None] * FAN + steps)[:, :, None], FAN, axis=2).ravel()
            right = np.repeat((b[:, None] * FAN + steps)[:, None, :], FAN, axis=1).ravel()
            fits = (left <= right) & (right < n) & (left < n)
            left, right = left[fits], right[fits]
            pattern, mask = self.patterns[level - 1], self.masks[level - 1]
            apart = (pattern[left] ^ pattern[right]) & mask[left] & mask[right]
            near = (np.bitwise_count(apart) <= distance) & (apart & same == 0)
            if near.any():
                stack.append((level - 1, left[near], right[near]))


def spanning(n: int, found: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[int, int]]:
    """The links that join parts not yet joined: at most n - 1 of them."""
    parent = list(range(n))

    def top(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for left, right in found:
        for i, j in zip(left.tolist(), right.tolist(), strict=True):
            a, b = top(i), top(j)
            if a != b:
                parent[max(a, b)] = min(a, b)
                yield i, j


@dataclass(frozen=True)
class Kind:
    """A way to choose places: codes are turned left by `turn`, and the bits of `same` must agree."""

    turn: int
    same: int


def _bits(skip: int, width: int) -> int:
    return ((1 << width) - 1) << (64 - skip - width)


def _kinds() -> tuple[list[Kind], list[list[Kind]]]:
    """One kind per block, and for each of them the three kinds that cut it again."""
    first, second, skip = [], [], 0
    for width in BLOCKS:
        first.append(Kind(skip, _bits(0, width)))
        rest = 64 - width
        inner = (rest - 2 * (rest // 3), rest // 3, rest // 3)
        second.append([Kind(skip, _bits(0, width) | _bits(width + sum(inner[:i]), inner[i])) for i in range(3)])
        skip += width
    return first, second


FIRST, SECOND = _kinds()
KINDS = [*FIRST, *[k for inner in SECOND for k in inner]]


def _signed(number: int) -> int:
    return number - (1 << 64) if number >= 1 << 63 else number


def _place(code: Column, number: int) -> Column:
    kind = KINDS[number]
    turned = code
    if kind.turn:
        turned = F.shiftleft(code, kind.turn).bitwiseOR(F.shiftrightunsigned(code, 64 - kind.turn))
    return F.struct(
        F.lit(number).alias("kind"),
        F.xxhash64(F.lit(number), turned.bitwiseAND(F.lit(_signed(kind.same)).cast("long"))).alias("place"),
    )


def _search(distance: int):
    def index(rows: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        code, kind = (np.concatenate(x) for x in zip(*rows, strict=True))
        out = []
        for number in np.unique(kind).tolist():
            own = np.unique(code[kind == number])
            turned = rotated(own, KINDS[number].turn)
            order = np.argsort(gray_rank(turned))
            own, turned = own[order], turned[order]
            near = GrayIndex(turned).pairs(distance, np.uint64(KINDS[number].same))
            out += [(own[i], own[j]) for i, j in spanning(len(own), near)]
        pairs = np.array(out, np.uint64).reshape(-1, 2).view(np.int64)
        return pa.record_batch([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["u", "v"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size, last = 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            code = batch.column("code").to_numpy(zero_copy_only=False).view(np.uint64)
            kind = batch.column("kind").to_numpy(zero_copy_only=False)
            place = batch.column("place").to_numpy(zero_copy_only=False)
            if size >= INDEX_ROWS:
                # cut where a new place begins, so that no place is parted
                begins = np.flatnonzero(np.r_[place[0] != last, place[1:] != place[:-1]])
                if len(begins):
                    at = int(begins[0])
                    yield index([*held, (code[:at], kind[:at])])
                    held, size, code, kind = [], 0, code[at:], kind[at:]
            held.append((code, kind))
            size += len(code)
            last = place[-1]
        if held:
            yield index(held)

    return search


def links(codes: DataFrame, distance: int = DISTANCE, cut_above: int = CUT_ABOVE) -> DataFrame:
    """Spanning links (u, v) between the distinct values of `code` that differ in at most `distance` (0 to 2) bits."""
    code = F.col("code")
    spread = codes.select("code", F.explode(F.array(*[_place(code, i) for i in range(len(FIRST))])).alias("of"))
    placed = spread.select("code", "of.kind", "of.place")
    if codes.count() > cut_above:
        crowded = placed.groupBy("kind", "place").count().filter(F.col("count") > cut_above).select("kind", "place")
        crowded = stored(crowded, "crowded")  # fewer than three per `cut_above` codes
        again = F.array(
            *[F.array(*[_place(code, len(FIRST) + 3 * i + k) for k in range(3)]) for i in range(len(FIRST))]
        )
        inside = placed.join(crowded, ["kind", "place"], "left_semi").select(
            "code", F.explode(F.get(again, F.col("kind"))).alias("of")
        )
        placed = placed.join(crowded, ["kind", "place"], "left_anti").unionByName(inside.select("code", "of.kind", "of.place"))
    return (
        placed.repartition("place").sortWithinPartitions("place").mapInArrow(_search(distance), "u long, v long").distinct()
    )


def rooted(hashed: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """For rows with a `code` the table (code, root) of the distinct codes; codes of one group have one root."""
    codes = stored(hashed.select("code").distinct(), "codes")
    roots = components.roots(links(codes, distance))
    return codes.join(roots, F.col("code") == F.col("u"), "left").select("code", F.coalesce("root", "code").alias("root"))


def grouped(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """doc_id, code (signed) and component_id, the smallest id that the document reaches by links, of each row of (doc_id, text)."""
    hashed = stored(docs.select("doc_id", fingerprints(F.col("text")).alias("code")), "fingerprints")
    least = hashed.groupBy("code").agg(F.min("doc_id").alias("least"))
    known = stored(rooted(hashed, distance).join(least, "code"), "rooted")
    smallest = known.groupBy("root").agg(F.min("least").alias("component_id"))
    members = stored(known.join(smallest, "root").select("code", "component_id"), "members")
    return hashed.join(members, "code").select("doc_id", "code", "component_id")


def kept_rows(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """One row of each group with all its columns: that of the smallest id (null last), then of the smallest digest."""
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64(whole_text()).alias("digest"), "code")
    coded = docs.select(F.struct("*").alias("__row"), "doc_id", "text", fingerprints(F.col("text")).alias("code"))
    hashed = stored(coded.select(key.alias("__key"), "code"), "fingerprints")
    least = hashed.groupBy("code").agg(F.min("__key").alias("least"))
    best = rooted(hashed, distance).join(least, "code").groupBy("root").agg(F.min("least").alias("__key"))
    best = stored(best.select("__key"), "best")
    # rows that agree in id and text are alike: the first of them is taken
    order = F.row_number().over(Window.partitionBy("__key").orderBy(F.lit(0)))
    return (
        coded.select("__row", key.alias("__key"))
        .join(best, "__key", "left_semi")
        .withColumn("__place", order)
        .filter(F.col("__place") == 1)
        .select("__row.*")
    )
