"""Document fingerprints by spot signatures.

Every occurrence of a common word (an anchor) starts a signature: the chain of the next content words behind it, anchors skipped.
A fingerprint is the set of a text's signatures, written as sorted 32-bit hashes; its size in front. Texts in which signatures are too
few (short ones, or without common words) also get chains that start at every word, and then runs of letters. Likeness is the Jaccard similarity of two sets.

`similar_pairs` compares whole tables: sets are split by length into ranges, so that sets whose lengths alone rule a pair out never
meet; inside a range a set is sent only to its rarest signatures, as many as any similar set must share one of, and the merge of two
sorted sets stops as soon as the threshold cannot be reached.

Defined cases: a null text is the empty text, whose set is empty; two empty sets have likeness 1, an empty and another one 0;
repeated rows have equal fingerprints; with one document the next document is itself; rows with equal ids follow each other
by text; null ids come last.
"""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from twinseek.llm.common import stored, whole_text

# Content words of a chain, and the number of signatures below which every word starts a chain.
CHAIN, FEW = 3, 16
# Letters of a run.
LETTERS = 5
DIGITS = 8
THRESHOLD = 0.8
# Bytes of text of one range of ids, and the most ranges: beyond these, ranges grow, and the driver never holds more of them.
RANGE_BYTES, MOST_RANGES = 1 << 20, 1 << 16
MARKS = "!?.,;:\"'()[]{}<>*_-~#/\\|`…«»„“”¡¿"
# Common words of English, German, French and Spanish that serve as anchors.
ANCHORS = frozenset(
    "the a an is are was were of and to in that it for on with as be by at this or from "
    "der die das und ist in den von zu mit sich des auf für im ein eine dem nicht als "
    "le la les de des du un une et est à que qui dans pour sur au ne pas se "
    "el los las y es en que del se por con una su para al lo como".split()
)


def signatures(text: str | None) -> np.ndarray:
    """Sorted distinct 32-bit hashes of the chains of a text."""
    words = [w for w in (w.strip(MARKS) for w in (text or "").lower().split()) if w]
    content = []
    starts = []
    for word in words:
        if word in ANCHORS:
            starts.append((word, len(content)))
        else:
            content.append(word)
    n = len(content)
    chains = {f"{a} {' '.join(content[i : i + CHAIN])}" for a, i in starts if i + CHAIN <= n}
    if words and len(chains) < FEW:
        chains |= {"* " + " ".join(words[i : i + CHAIN]) for i in range(max(1, len(words) - CHAIN + 1))}
    if words and len(chains) < FEW:
        line = " ".join(words)
        chains |= {"+ " + line[i : i + LETTERS] for i in range(max(1, len(line) - LETTERS + 1))}
    digest = xxhash.xxh32_intdigest
    return np.array(sorted({digest(c.encode()) for c in chains}), np.uint32)


def written(hashes: np.ndarray) -> str:
    """A fingerprint as text: number of signatures, colon, hashes of eight hexadecimal digits."""
    return f"{len(hashes)}:{hashes.astype('>u4').tobytes().hex()}"


def read(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint.partition(":")[2]), ">u4")


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets."""
    if not len(a) and not len(b):
        return 1.0
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common)


def at_least(a: np.ndarray, b: np.ndarray, threshold: float) -> float | None:
    """Likeness if it reaches the threshold, else None; the lengths and then a merge in halves give up early."""
    n, m = len(a), len(b)
    if not n and not m:
        return 1.0
    if min(n, m) < threshold * max(n, m):
        return None
    needed = math.ceil(threshold / (1 + threshold) * (n + m) - 1e-9)
    middle = np.uint32(1 << 31)
    i, j = np.searchsorted(a, middle), np.searchsorted(b, middle)
    low = len(np.intersect1d(a[:i], b[:j], assume_unique=True))
    if low + min(n - i, m - j) < needed:
        return None
    common = low + len(np.intersect1d(a[i:], b[j:], assume_unique=True))
    return common / (n + m - common) if common >= needed else None


def fingerprints(text: Column) -> Column:
    def hashed(texts: pa.Array) -> pa.Array:
        return pa.array([written(signatures(t)) for t in texts.to_pylist()], pa.string())

    return F.arrow_udf(hashed, "string")(text)


def edited(text: str, following: str) -> str:
    """The text with its last third replaced by the beginning of the following one."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


EDITED = (
    "doc_id {id}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document with the one behind it; a partition holds ranges in order, and each range ends with the next one's first row."""
    before, codec = None, pa.Codec("zstd")
    for batch in batches:
        out = []
        columns = (batch.column(c).to_pylist() for c in ("part", "doc_id", "packed", "bytes", "extra"))
        for part, doc_id, packed, size, extra in zip(*columns, strict=True):
            text = codec.decompress(packed, size, asbytes=True).decode() if size else ""
            own = signatures(text)
            if before is not None and before[0] == part:
                _, id_, first, mine = before
                changed = edited(first, text)
                other = signatures(changed)
                digest = hashlib.sha256(changed.encode()).hexdigest()
                row = (id_, len(first), digest, written(mine), written(other), likeness(mine, other), likeness(mine, own))
                out.append(row)
            before = None if extra else (part, doc_id, text, own)
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        kinds = [batch.schema.field("doc_id").type, pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2]
        lists = list(zip(*out, strict=True)) or [()] * len(names)
        yield pa.record_batch([pa.array(v, k) for v, k in zip(lists, kinds, strict=True)], names)


def compared_with_edits(docs: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """For each row of (doc_id, text) its fingerprint, that of its edited text, and their likenesses.

    Documents are put in descending order of id in ranges of about equal bytes. The order of ids is settled first, on ids and lengths
    alone; the text is then dealt to the ranges in one shuffle, the first document of each range going to the range before it as well.
    """
    text = whole_text()
    # rising keys that give falling ids, null last, equal ids by text
    none, down = F.col("doc_id").isNull().alias("none"), F.coalesce(F.bitwise_not(F.col("doc_id").cast("long")), F.lit(0))
    rows = docs.select("doc_id", text.alias("text"), none, down.alias("down"), F.xxhash64(text).alias("hash"))
    order = ["none", "down", "hash"]
    sizes = stored(rows.select(*order, F.octet_length("text").cast("long").alias("bytes")), "sizes")
    total = sizes.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("b"), F.count("*").alias("n")).first()
    ranges = max(1, min(total["n"], MOST_RANGES, -(-total["b"] // range_bytes)))
    parted = sizes.repartitionByRange(ranges, *order).select(F.struct(*order).alias("key"), F.spark_partition_id().alias("part"))
    # the first key of each range: MOST_RANGES rows at most
    begins = sorted(tuple(r["key"]) for r in parted.groupBy("part").agg(F.min("key").alias("key")).collect())

    def placed(none: pa.Array, down: pa.Array, hash_: pa.Array) -> pa.Array:
        out = []
        for key in zip(none.to_pylist(), down.to_pylist(), hash_.to_pylist(), strict=True):
            part = bisect_right(begins, key) - 1
            out.append([part, (part - 1) % len(begins)] if key == begins[part] else [part])
        return pa.array(out, pa.list_(pa.int32()))

    def shrunk(texts: pa.Array) -> pa.Array:
        codec = pa.Codec("zstd")
        return pa.array([codec.compress(t.encode(), asbytes=True) for t in texts.to_pylist()], pa.binary())

    # texts travel compressed one by one: the shuffle's own compression sees only short stretches of them
    dealt = rows.select(
        "doc_id",
        F.arrow_udf(shrunk, "binary")("text").alias("packed"),
        F.octet_length("text").alias("bytes"),
        *order,
        F.arrow_udf(placed, "array<int>")(*order).alias("parts"),
    ).select("doc_id", "packed", "bytes", *order, F.posexplode("parts").alias("extra", "part"))
    laid = dealt.repartition("part").sortWithinPartitions("part", "extra", *order)
    schema = EDITED.format(id=docs.schema["doc_id"].dataType.simpleString())
    return laid.select("part", "doc_id", "packed", "bytes", "extra").mapInArrow(_compared, schema)


def _agreeing(threshold: float):
    def agreeing(a: pa.Array, b: pa.Array) -> pa.Array:
        pairs = zip(a.to_pylist(), b.to_pylist(), strict=True)
        return pa.array([at_least(read(x), read(y), threshold) for x, y in pairs], pa.float64())

    return agreeing


def similar_pairs(docs: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """Classes of equal fingerprints (doc_id, class_id) and the similar pairs between classes (a, b, likeness).

    A class is known by its smallest id. Lengths fall into ranges that grow by 1 / threshold, so that a similar pair lies in one range or in
    two that touch; signatures are ordered by how many classes have them, and a set is looked up by its rarest only.
    """
    known = stored(docs.select("doc_id", fingerprints(F.col("text")).alias("fingerprint")), "fingerprints")
    classes = stored(known.groupBy("fingerprint").agg(F.min("doc_id").alias("class_id")), "classes")
    n = F.substring_index("fingerprint", ":", 1).cast("int")
    digits = F.substring_index("fingerprint", ":", -1)
    each = classes.filter(n > 0).select(
        "class_id",
        n.alias("n"),
        F.floor(F.log(n) / F.lit(-math.log(threshold)) + F.lit(1e-9)).alias("range"),
        F.explode(F.regexp_extract_all(digits, F.lit(f"[0-9a-f]{{{DIGITS}}}"), F.lit(0))).alias("signature"),
    )
    counts = each.groupBy("signature").agg(F.count("*").alias("classes"))
    ranked = each.join(counts, "signature").withColumn(
        "place", F.row_number().over(Window.partitionBy("class_id").orderBy("classes", "signature"))
    )
    looked = ranked.filter(F.col("place") <= F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1)
    looked = stored(looked.select("class_id", "n", "range", "signature"), "looked-up")
    left = looked.select(F.col("class_id").alias("a"), F.col("n").alias("n_a"), "range", "signature")
    right = looked.withColumn("range", F.explode(F.array("range", F.col("range") + 1))).select(
        F.col("class_id").alias("b"), F.col("n").alias("n_b"), "range", "signature"
    )
    fits = (F.col("n_b") >= F.col("n_a") * threshold - 1e-9) & ((F.col("n_b") < F.col("n_a")) | ((F.col("n_a") == F.col("n_b")) & (F.col("a") < F.col("b"))))
    near = left.join(right, ["range", "signature"]).filter(fits).select("a", "b").distinct()
    print_of = classes.select("class_id", "fingerprint")
    pairs = (
        near.join(print_of.withColumnsRenamed({"class_id": "a", "fingerprint": "print_a"}), "a")
        .join(print_of.withColumnsRenamed({"class_id": "b", "fingerprint": "print_b"}), "b")
        .select("a", "b", F.arrow_udf(_agreeing(threshold), "double")("print_a", "print_b").alias("likeness"))
        .filter(F.col("likeness").isNotNull())
    )
    return known.join(classes, "fingerprint").select("doc_id", "class_id"), pairs
