"""Substring removal by words and by bytes against plain versions."""

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from xxhash import xxh3_128_digest

from twinseek.llm import substring_dedup, suffix_dedup
from twinseek.llm.common import joined_bytes, word_bounds

BIG = float("inf")


def number(doc_id):
    return BIG if doc_id is None else doc_id


def plain(rows, split, window):
    """doc id, units, removed units, removed runs, kept units for each row."""
    first = {}
    units = [(r[0], split(r[1] or "")) for r in rows]
    for doc_id, u in units:
        for i in range(len(u) - window + 1):
            key = tuple(u[i : i + window])
            first[key] = min(first.get(key, BIG), number(doc_id))
    for doc_id, u in units:
        gone = [False] * len(u)
        for i in range(len(u) - window + 1):
            if first[tuple(u[i : i + window])] < number(doc_id):
                gone[i : i + window] = [True] * window
        runs = sum(g and not b for g, b in zip(gone, [False, *gone], strict=False))
        yield doc_id, len(u), sum(gone), runs, [x for x, g in zip(u, gone, strict=True) if not g]


def sha(data):
    return hashlib.sha256(data).hexdigest()


@pytest.mark.parametrize("window", [50, 7])
def test_words(docs, rows, window):
    want = Counter(
        (d, n, gone, sha(b" ".join(kept))) for d, n, gone, _, kept in plain(rows, lambda t: t.encode().split(), window)
    )
    found = substring_dedup.dedup(docs, window)
    assert found.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    assert Counter(map(tuple, found.collect())) == want


@pytest.mark.parametrize(("window", "crowded"), [(50, 20_000), (50, 1), (20, 3)])
def test_bytes(docs, rows, window, crowded):
    want = Counter(
        (d, n, gone, runs, sha(bytes(kept))) for d, n, gone, runs, kept in plain(rows, lambda t: t.encode(), window)
    )
    found = suffix_dedup.dedup(docs, window, crowded)
    assert found.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert Counter(map(tuple, found.collect())) == want


def test_empty_tables(empty):
    assert substring_dedup.dedup(empty).collect() == []
    assert suffix_dedup.dedup(empty).collect() == []


@pytest.mark.parametrize("window", [8, 9, 12])
def test_merged_order_is_that_of_all_windows(window):
    random = np.random.default_rng(3)
    reads = [bytes(random.integers(97, 100, random.integers(window, 30), dtype=np.uint8)) for _ in range(60)]
    shards = [np.frombuffer(b"".join(r + b"\xff" for r in reads[i : i + 7]), np.uint8) for i in range(0, 60, 7)]
    text = np.concatenate(shards)
    lengths = np.array([len(r) + 1 for r in reads])
    begins = np.cumsum(lengths) - lengths
    starts = np.concatenate([b + np.arange(n - window) for b, n in zip(begins, lengths, strict=True)])
    places = suffix_dedup.merge(shards, window, starts)
    assert sorted(places.tolist()) == sorted(starts.tolist())
    keys = [text[p : p + window].tobytes() for p in places]
    assert keys == sorted(keys)
    prefix = suffix_dedup.common_prefixes(text, places, window)
    for i in range(1, len(keys)):
        assert prefix[i] == next((j for j in range(window) if keys[i][j] != keys[i - 1][j]), window)


def test_window_keys_depend_on_the_window_alone():
    random = np.random.default_rng(4)
    inner = random.integers(0, 5, 400).astype(np.uint64) + np.uint64(1)
    sides = [random.integers(0, 5, n).astype(np.uint64) + np.uint64(1) for n in (60, 7, 0, 31)]
    one = np.r_[sides[0], inner, sides[1]]
    two = np.r_[sides[2], inner, sides[3]]
    names = substring_dedup.mixed(np.r_[one, two])
    of, starts, key = substring_dedup.window_keys(names, np.array([len(one), len(two)]), 20)
    first = {s - 60: k for o, s, k in zip(of, starts, key, strict=True) if o == 0}
    second = {s - len(one): k for o, s, k in zip(of, starts, key, strict=True) if o == 1}
    assert all(first[i] == second[i] for i in range(len(inner) - 19))


def test_words_that_rolling_hashes_confuse(spark):
    """Polynomials modulo 2^64 give this word and its complement one name, whatever the base."""
    word = "a"
    for _ in range(10):
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    rest = " ".join(f"w{i}" for i in range(49))
    docs = spark.createDataFrame([(1, f"{word} {rest}"), (2, f"{other} {rest}"), (3, f"{word} {rest}")], "doc_id long, text string")
    found = {r["doc_id"]: r["n_removed"] for r in substring_dedup.dedup(docs).collect()}
    assert found == {1: 0, 2: 0, 3: 50}


def test_word_names_are_digests_of_the_words():
    texts = pa.array(["one  two", "", "two", "x" * 5000 + "\ttwo", "é"])
    buffer, offsets = joined_bytes(texts)
    starts, ends, _ = word_bounds(buffer, offsets)
    one, two = substring_dedup.word_names(buffer, starts, ends)
    words = [w for t in texts.to_pylist() for w in t.encode().split()]
    assert [a.tobytes() + b.tobytes() for a, b in zip(one, two, strict=True)] == [xxh3_128_digest(w) for w in words]


@pytest.mark.parametrize("letters", [2, 250])
def test_suffix_order_by_whole_windows(letters):
    text = np.random.default_rng(3).integers(0, letters, 70_000).astype(np.uint8)
    for shard in (text[:1], text[:3], text[:4_000], text):
        ring = np.resize(shard, len(shard) + 50).tobytes()
        order = suffix_dedup.suffix_order(shard, 50).tolist()
        windows = [ring[i : i + 50] for i in order]
        assert sorted(order) == [*range(len(shard))]
        assert windows == sorted(windows)


def test_reads_alone_with_their_gram_are_not_merged(monkeypatch):
    merged = []
    repeated = suffix_dedup.repeated

    def seen(reads, *rest):
        merged.extend(reads)
        return repeated(reads, *rest)

    monkeypatch.setattr(suffix_dedup, "repeated", seen)
    alone, one, other = b"abcdefg" * 8, b"x" * 50 + b"1234", b"x" * 50 + b"5678"
    reads = [(1, 9, 4, alone), (1, 2, 0, alone), (2, 5, 7, one), (2, 3, 0, other), (3, None, 1, alone[::-1])]
    key, ids, place, read = zip(*reads, strict=True)
    columns = [pa.array(key), pa.array(ids), pa.array(ids), pa.array(ids, pa.int64()), pa.array(place), pa.array(read)]
    batch = pa.record_batch(columns, ["key", "d", "e", "doc_id", "place", "read"])
    found = [r for b in suffix_dedup._judged(50)(iter([batch])) for r in b.to_pylist()]
    assert merged == [one, other]
    assert [(r["doc_id"], r["places"]) for r in found] == [(9, [4, 10]), (5, [7])]
