"""Encoding, fingerprints, secrets and sharding of single texts against plain versions."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from twinseek.llm import bpe, queries, secrets, sharding, simhash, spotsigs

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
VOCABULARY = bpe.load(PATH)


def sha(data):
    return hashlib.sha256(data).hexdigest()


# ---- byte-pair encoding


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("abeinrst  \n'é !0<|>"), st.characters(codec="utf-8")), max_size=60))
def test_ids_are_those_of_the_library(text):
    encoder = VOCABULARY.encoder()
    ids = np.frombuffer(encoder.encode(text), "<u4").tolist()
    assert ids == LIBRARY.encode(text, add_special_tokens=False).ids
    assert VOCABULARY.decoder().decode(encoder.encode(text)).decode() == text


def test_long_pieces_and_special_strings():
    encoder = VOCABULARY.encoder()
    for text in ("a" * 3000, "ab" * 2000, "<|endoftext|>x<|endoftext|><|endoftext|>", "don't we'll", "x" * 50 + " " * 70):
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


def test_bpe_query(spark, table_folder, rows):
    want = Counter()
    for doc_id, text, *_ in rows:
        ids = LIBRARY.encode(text or "", add_special_tokens=False).ids
        decoded = LIBRARY.decode(ids, skip_special_tokens=False)
        want[doc_id, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(decoded.encode())] += 1
    assert Counter(map(tuple, queries.op8_bpe(spark, table_folder).collect())) == want


# ---- SimHash


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def plain_groups(codes, distance=2):
    parent = list(range(len(codes)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(codes)):
        for j in range(i):
            if bin(codes[i] ^ codes[j]).count("1") <= distance:
                parent[top(i)] = top(j)
    return [top(i) for i in range(len(codes))]


def test_simhash_query(spark, table_folder, rows):
    codes = [plain_fingerprint(r[1]) for r in rows]
    groups = plain_groups(codes)
    least = defaultdict(list)
    for g, r in zip(groups, rows, strict=True):
        least[g] += [r[0]] if r[0] is not None else []
    want = Counter((r[0], f"{c:016x}", min(least[g], default=None)) for r, c, g in zip(rows, codes, groups, strict=True))
    assert Counter(map(tuple, queries.op4_simhash(spark, table_folder).collect())) == want


@pytest.mark.parametrize("cut_above", [5, 100_000])
def test_links_lose_nothing(spark, cut_above):
    random = np.random.default_rng(1)
    base = random.integers(0, 1 << 62, 25, dtype=np.uint64)
    near = [base ^ (np.uint64(1) << random.integers(0, 64, 25, dtype=np.uint64)) for _ in range(12)]
    nearer = [n ^ (np.uint64(1) << random.integers(0, 64, 25, dtype=np.uint64)) for n in near]
    codes = np.unique(np.concatenate([base, *near, *nearer]))
    table = spark.createDataFrame([(int(c),) for c in codes.view(np.int64)], "code long")
    found = {r["u"]: r["root"] for r in simhash.components.roots(simhash.links(table, 2, cut_above)).collect()}
    groups = plain_groups([int(c) for c in codes])
    members = defaultdict(list)
    for g, c in zip(groups, codes.view(np.int64).tolist(), strict=True):
        members[g].append(c)
    assert found == {c: min(m) for m in members.values() for c in m if c != min(m)}


def test_one_row_of_each_group_stays(docs, rows, empty):
    kept = simhash.kept_rows(docs)
    assert kept.columns == docs.columns
    groups = plain_groups([plain_fingerprint(r[1]) for r in rows])
    got = [tuple(r)[:5] for r in kept.collect()]
    assert len(got) == len(set(groups))
    best = {}
    for g, r in zip(groups, rows, strict=True):
        best[g] = min(best.get(g, float("inf")), float("inf") if r[0] is None else r[0])
    assert Counter(float("inf") if r[0] is None else r[0] for r in got) == Counter(best.values())
    assert simhash.kept_rows(empty).collect() == []


# ---- spot signatures


def test_spot_signature_query(spark, table_folder, rows):
    ordered = sorted(
        ((r[0], r[1] or "") for r in rows),
        key=lambda r: (r[0] is None, -(r[0] or 0), np.int64(np.uint64(xxhash.xxh64_intdigest(r[1].encode(), 42)))),
    )
    want = Counter()
    for i, (doc_id, text) in enumerate(ordered):
        following = ordered[(i + 1) % len(ordered)][1]
        third = len(text) // 3
        changed = text[: len(text) - third] + following[:third]
        a, b, c = map(spotsigs.signatures, (text, changed, following))
        likes = [len(set(a) & set(x)) / len(set(a) | set(x)) if len(a) or len(x) else 1.0 for x in (b, c)]
        want[doc_id, len(text), sha(changed.encode()), spotsigs.written(a), spotsigs.written(b), *likes] += 1
    assert Counter(map(tuple, queries.op7_spotsigs(spark, table_folder).collect())) == want


@pytest.mark.parametrize("threshold", [0.3, 0.8])
def test_similar_pairs(docs, rows, threshold):
    classes, pairs = spotsigs.similar_pairs(docs.filter("doc_id is not null"), threshold)
    of = {}
    for r in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        of.setdefault(spotsigs.written(spotsigs.signatures(r[1])), r[0])
    assert {r["class_id"] for r in classes.collect()} == set(of.values())
    sets = {i: set(spotsigs.read(f).tolist()) for f, i in of.items()}
    want = {}
    for a in sets:
        for b in sets:
            if a < b and (sets[a] or sets[b]) and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
                want[a, b] = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    assert {(min(r["a"], r["b"]), max(r["a"], r["b"])): r["likeness"] for r in pairs.collect()} == want


# ---- secrets

PLAIN = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 24),
)


def plain_spans(text):
    found = []
    for number, (kind, pattern, part, least) in enumerate(PLAIN):
        found += [(m.start(), number, m.end(), kind) for m in pattern.finditer(text or "") if len(m[part]) >= least]
    return sorted(found)


def test_secrets_query(spark, table_folder, rows):
    want = Counter()
    for doc_id, text, *_ in rows:
        spans = plain_spans(text)
        line = ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans)
        counts = [sum(s[3] == k for s in spans) for k in ("assign", "access", "hex")]
        want[doc_id, *counts, sha(line.encode()), line] += 1
    assert Counter(map(tuple, queries.op9_secrets(spark, table_folder).collect())) == want


def test_ledger_scans_only_what_is_new(docs):
    first = secrets.scan(docs.filter("doc_id < 20"), rules=secrets.RULES[:2])
    ledger = spark_copy(first)
    second = secrets.scan(docs, ledger)
    done = {(r["blob"], r["rule"]) for r in ledger.collect()}
    new = [(r["blob"], r["rule"]) for r in second.collect()]
    assert done and len(new) == len(set(new)) and not done & set(new)
    whole = {(r["blob"], r["rule"], str(r["spans"])) for r in secrets.scan(docs).collect()}
    assert {(r["blob"], r["rule"], str(r["spans"])) for r in ledger.unionByName(second).collect()} == whole


def spark_copy(df):
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def plain_masked(text):
    for _, pattern, part, least in PLAIN:

        def mask(m, part=part, least=least):
            return m[0] if len(m[part]) < least else m[0][: len(m[0]) - len(m[part])] + secrets.MARK

        text = pattern.sub(mask, text)
    return text


def test_masked_rows(docs, rows, empty):
    masked = secrets.redacted_rows(docs)
    assert masked.columns == docs.columns
    want = Counter()
    for doc_id, text, lang, source, n_chars in rows:
        if plain_spans(text):
            text = plain_masked(text)
            n_chars = len(text)
        want[doc_id, text, lang, source, n_chars] += 1
    assert Counter(tuple(r)[:5] for r in masked.collect()) == want
    assert secrets.redacted_rows(empty).collect() == []
    assert secrets.scan(empty).collect() == []


# ---- sharding


def test_sharding_query(spark, table_folder, rows):
    found = queries.op10_sharding(spark, table_folder).collect()
    want = Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert Counter(tuple(r)[:3] for r in found) == want
    for shard in range(8):
        slots = sorted(r["slot"] for r in found if r["shard"] == shard)
        assert slots == list(range(len(slots)))
    assert {r["law"] for r in found} == {"bytes"} and {r["shard"] for r in found} <= set(range(8))


def test_shards_are_nearly_equal(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.expr("repeat('x', cast(pmod(hash(id), 900) as int))").alias("text"))
    sums = [r["b"] for r in sharding.shard(docs, 8).groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(sums) == 8 and max(sums) <= 1.01 * min(sums)


def test_map_edits_move_little_and_are_stored(spark, tmp_path):
    loads = {s: (s * 37) % 101 + 1 for s in range(512)}
    placed = sharding.build_map(loads, 8, 512)
    grown = sharding.edit_map(placed, loads, 9)
    moved = [s for s in placed if placed[s] != grown[s]]
    assert all(grown[s] == 8 for s in moved) and len(moved) < 512 / 8
    weights = [sum(loads[s] for s in grown if grown[s] == k) for k in range(9)]
    assert max(weights) <= 1.05 * sum(weights) / 9
    shrunk = sharding.edit_map(grown, loads, 8)
    assert set(shrunk.values()) == set(range(8))
    sharding.write_map(spark, str(tmp_path / "maps"), 1, placed)
    sharding.write_map(spark, str(tmp_path / "maps"), 2, grown)
    assert {r[0]: r[1] for r in sharding.read_map(spark, str(tmp_path / "maps")).select("virtual_slot", "shard").collect()} == grown
    first = sharding.read_map(spark, str(tmp_path / "maps"), 1)
    assert {r[0]: r[1] for r in first.select("virtual_slot", "shard").collect()} == placed


def test_empty_tables(spark, empty, tmp_path):
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("op4_simhash", "op7_spotsigs", "op8_bpe", "op9_secrets", "op10_sharding"):
        assert queries.REGISTRY[name](spark, str(tmp_path)).collect() == [], name
