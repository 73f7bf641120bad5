import random

import numpy as np
import pytest

from twinseek.llm import hard_negatives as hn
from twinseek.llm import queries

COLUMNS = "vec_id long, embedding array<float>, label int, extra int, row int, rank int, score int, shard int"


def brute(rows, positives=5, negatives=10):
    held = []
    for place, (vec_id, vector, label) in enumerate(rows):
        if vector is None or label is None or any(x is None or not np.isfinite(x) for x in vector):
            continue
        if vec_id is not None and vec_id % 7 == 0:
            label = (label + 1) % 10
        held.append((place, vec_id, [int(np.floor(256 * float(np.float32(x)))) for x in vector], label))
    found = []
    last = hn.LIMIT

    def order(other):
        return -other[0], other[1] is None, other[1] or 0, other[2]

    for place, vec_id, vector, label in held:
        if vec_id is None or vec_id % 100:
            continue
        scored = []
        for p, i, v, l in held:
            if len(v) == len(vector):
                scored.append((max(-last, min(last, sum(a * b for a, b in zip(vector, v)))), i, p, l))
        same = sorted((s for s in scored if s[3] == label and s[2] != place), key=order)[:positives]
        for score, positive, _, _ in same:
            inside = sorted((s for s in scored if s[3] != label and 30 * score <= 100 * s[0] <= 90 * score), key=order)
            found += [(vec_id, positive, r, s[1], score, s[0]) for r, s in enumerate(inside[:negatives], 1)]
    return sorted(map(repr, found))


def made(n, dims, seed):
    random.seed(seed)
    rows = []
    for i in range(n):
        vector = [random.gauss(0.15, 0.3) for _ in range(dims)]
        rows.append((i, vector, random.randint(0, 3)))
    if n > 200:
        rows += [(None, rows[5][1], 1), (700, None, 1), (800, rows[0][1], None), (900, [float("nan")] * dims, 1), (3, [None] * dims, 2)]
        rows += [(100, rows[100][1], 2), rows[200], rows[200], (1000, [1.0, 2.0], 1), (1001, [2.0, 1.0], 1), (1002, [1.0, 0.5], 2), (1003, [], 1)]
        # a hot vector: every score of it ties
        rows += [(2000 + i, rows[7][1], 2) for i in range(60)]
    return rows


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, 4, 5) for r in rows], COLUMNS)


@pytest.mark.parametrize(("shard_rows", "block"), [(40, 2), (8192, 2048)])
def test_query_against_brute_force(spark, tmp_path, monkeypatch, shard_rows, block):
    monkeypatch.setattr(hn, "SHARD_ROWS", shard_rows)
    monkeypatch.setattr(hn, "BLOCK_ANCHORS", block)
    rows = made(420, 12, 3)
    table(spark, rows).repartition(5).write.parquet(f"{tmp_path}/embeddings.parquet")
    found = queries.REGISTRY["op11_hard_negatives"](spark, str(tmp_path))
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(repr(tuple(r)) for r in found.collect()) == brute(rows)


def test_empty_table(spark, tmp_path):
    table(spark, made(3, 2, 1)).limit(0).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert queries.REGISTRY["op11_hard_negatives"](spark, str(tmp_path)).collect() == []


@pytest.mark.parametrize("reach", [1, 300, 1 << 20, 1 << 40, 1 << 62])
@pytest.mark.parametrize("dims", [1, 64, 150])
def test_scores_are_exact(reach, dims):
    random.seed(reach + dims)
    a, b = ([[random.randint(-reach, reach) for _ in range(dims)] for _ in range(n)] for n in (5, 9))
    a[0], b[0] = [reach] * dims, [-reach] * dims
    exact = [[max(-hn.LIMIT, min(hn.LIMIT, sum(x * y for x, y in zip(p, q)))) for q in b] for p in a]
    shard = hn.Shard(np.array(b), np.array(a))
    assert shard.scores(slice(0, 5)).tolist() == exact
    assert len(shard.primes) > 1 or dims * reach * reach < 512


def test_products_stay_below_what_float32_holds():
    primes = hn.moduli(1 << 100)
    assert max(primes) // 2 * (max(primes) // 2) * hn.WIDTH + max(primes) < 1 << 24
    assert len(set(primes)) == len(primes)


def test_bounds():
    for p in range(-300, 300):
        low, high = hn.bounds(p)
        assert [s for s in range(-400, 400) if 30 * p <= 100 * s <= 90 * p] == list(range(low, high + 1))


def test_best_takes_first_columns_among_ties():
    scores = np.array([[5, 7, 5, 5, 1], [1, 1, 1, 1, 1]])
    i, j = hn.best(scores, np.array([[1, 1, 1, 0, 1], [0, 0, 1, 0, 0]], bool), 2)
    assert list(zip(i.tolist(), j.tolist())) == [(0, 0), (0, 1), (1, 2)]
