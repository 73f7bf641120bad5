"""Mixing, top-k search, toxicity and the pipeline."""

import os
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from twinseek.llm import mixing, queries, topk, toxicity
from twinseek.llm.queries import REGISTRY

# ---- mixing


def plain_targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    target, left, open_ = {}, share * sum(sizes.values()), set(order)
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > most * sizes[s]}
        if not over:
            return target | {s: left * weight[s] / total for s in open_}
        for s in over:
            target[s] = most * sizes[s]
        left -= sum(target[s] for s in over)
        open_ -= over
    return target


def sized(rows):
    return [(r[0], len((r[1] or "").split(None)) if r[1] else 0, r[3]) for r in rows]


def test_mixing_query(spark, table_folder, rows):
    found = queries.op2_mixing(spark, table_folder).collect()
    words = [(r[0], len((r[1] or "").encode().split()), r[3]) for r in rows]
    assert Counter((r["doc_id"], r["size"], r["source"]) for r in found) == Counter(words)
    sizes = defaultdict(int)
    for _, n, s in words:
        sizes[s] += n
    targets = plain_targets(dict(sizes))
    taken = defaultdict(int)
    for r in found:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(targets[r["source"]])
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        taken[r["source"]] += r["taken"]
    biggest = defaultdict(int)
    for _, n, s in words:
        biggest[s] = max(biggest[s], n)
    for s, target in targets.items():
        assert abs(taken[s] - target) <= biggest[s]
    again = queries.op2_mixing(spark, table_folder).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, found))


def test_flight_keeps_both_totals():
    random = np.random.default_rng(2)
    size = random.integers(1, 500, 400)
    chance = random.random(400)
    flown = mixing.flight(chance, size, np.random.default_rng(9))
    assert ((flown > 0) & (flown < 1)).sum() <= 2
    assert flown.sum() == pytest.approx(chance.sum()) and (flown * size).sum() == pytest.approx((chance * size).sum())
    landed = mixing.landing(flown, size)
    assert set(landed.tolist()) <= {0.0, 1.0}
    assert abs((landed * size).sum() - (chance * size).sum()) <= 500


def test_blocks_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 16)
    monkeypatch.setattr(mixing, "GATHERED", 4)
    docs = spark.range(900).select(
        F.col("id").alias("doc_id"),
        F.expr("array_join(array_repeat('w', cast(pmod(hash(id), 40) as int)), ' ')").alias("text"),
        F.expr("if(id < 300, 'a', if(id < 500, 'b', 'c'))").alias("source"),
    )
    found = mixing.mix(docs)
    sums = found.groupBy("source").agg(F.sum(F.expr("size * (whole + chosen)")).alias("taken"), F.first("target").alias("target"))
    rows = sums.collect()
    assert len(rows) == 3 and found.count() == 900
    assert all(abs(r["taken"] - r["target"]) <= 40 for r in rows)


def test_taken_rows(docs, rows, empty):
    taken = mixing.taken_rows(docs)
    assert taken.columns == docs.columns
    want = Counter()
    for r in mixing.mix(docs).collect():
        want[r["doc_id"], r["source"], r["size"]] += r["whole"] + r["chosen"]
    got = Counter((r["doc_id"], r["source"], len((r["text"] or "").encode().split())) for r in taken.collect())
    assert got == +want
    assert mixing.taken_rows(empty).collect() == [] and mixing.mix(empty).collect() == []


# ---- top-k


def plain_top(vectors, k):
    whole = []
    for row, (vec_id, v) in enumerate(vectors):
        if v is not None and all(x is not None and np.isfinite(x) for x in v):
            whole.append((row, vec_id, [int(np.floor(1024 * float(np.float32(x)))) for x in v]))
    want = Counter()
    for row, query_id, q in whole:
        if query_id is None or query_id % 100:
            continue
        scores = []
        for other, vec_id, v in whole:
            if other != row and len(v) == len(q):
                scores.append((-sum(a * b for a, b in zip(q, v, strict=True)), vec_id is None, vec_id or 0, vec_id))
        for rank, s in enumerate(sorted(scores, key=lambda s: s[:3])[:k], 1):
            want[query_id, rank, s[3], -s[0]] += 1
    return want


def vector_rows():
    random = np.random.default_rng(8)
    rows = [(i, random.normal(size=6).tolist()) for i in range(330)]
    rows += [(i, [0.5, -0.25, 0.0, 0.0, 0.0, 1.0]) for i in range(400, 420)]
    rows += [(500, None), (501, [None] * 6), (502, [float("nan")] * 6), (503, [float("inf")] + [0.0] * 5), (600, [0.0] * 6)]
    rows += [(700, []), (701, []), (800, [1.0, 2.0]), (None, [1.0] * 6), (400, [1.0] * 6), (100, rows[100][1])]
    return rows


@pytest.mark.parametrize("shard_rows", [4096, 40])
def test_top_k(spark, monkeypatch, shard_rows):
    monkeypatch.setattr(topk, "SHARD_ROWS", shard_rows)
    monkeypatch.setattr(topk, "BLOCK_QUERIES", 3 if shard_rows < 100 else 1024)
    rows = vector_rows()
    table = spark.createDataFrame([(*r, 5) for r in rows], "vec_id long, embedding array<float>, row int").repartition(4)
    found = topk.top_k(table, F.col("vec_id") % 100 == 0, 10)
    assert Counter(map(tuple, found.collect())) == plain_top(rows, 10)
    assert topk.top_k(table.limit(0), F.col("vec_id") % 100 == 0, 10).collect() == []


def test_large_components_are_exact(spark):
    rows = [(100, [3e5, 2e6, -1.0]), (1, [1e6, 2e6, 1.0]), (2, [1e15, 1e15, 1.0]), (3, [-1e15, -1e15, 0.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = [tuple(r) for r in topk.top_k(table, F.col("vec_id") % 100 == 0, 10).orderBy("rank").collect()]
    assert [r[2] for r in found] == [2, 1, 3]
    assert found[0][3] == (1 << 63) - 1 and found[2][3] == -(1 << 63)


def test_lists_stop_early():
    random = np.random.default_rng(5)
    vectors = np.zeros((5000, 4))
    vectors[:, 0] = random.integers(0, 1000, 5000)
    vectors[:20, 0] = 5000 + np.arange(20)
    asked = np.array([[7.0, 0, 0, 0], [-1.0, 0, 0, 0]])
    found, scored = topk.SortedLists(vectors).best(asked[:1], 10, np.array([-1]), np.arange(5000))
    assert scored < 200 and sorted(s for _, _, s in found) == [7 * (5010 + i) for i in range(10)]
    found, scored = topk.SortedLists(vectors).best(asked, 10, np.array([19, 7]), np.arange(5000)[::-1])
    assert sorted(s for q, _, s in found if q == 0) == [7 * (5009 + i) for i in range(10)]
    least = sorted((vectors[r, 0], -r) for r in range(5000) if r != 7)[:10]
    assert sorted((-s, -r) for q, r, s in found if q == 1) == least


# ---- toxicity


def test_toxicity_query_on_the_fixture(spark, table_folder, rows):
    found = queries.op5_toxicity(spark, table_folder).collect()
    assert Counter(r["doc_id"] for r in found) == Counter(r[0] for r in rows)
    for r in found:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)


def test_labels_of_one_class_or_none(spark, docs, empty):
    labels = spark.createDataFrame([(1, 1), (2, 1), (5, 1)], "doc_id long, toxic int")
    for known, score in ((labels, 1.0), (labels.limit(0), 0.0)):
        model = toxicity.train(docs, known)
        assert {r["score"] for r in toxicity.scored(docs, model).collect()} == {score}
        assert toxicity.scored(empty, model).collect() == []


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    if not os.path.isdir(folder):
        pytest.skip("no tables")
    found = queries.op5_toxicity(spark, folder).filter("held_out")
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "toxic")
    rows = found.join(labels, "doc_id").select("score", "predicted", "toxic").toPandas()
    bad, good = rows[rows.toxic == 1], rows[rows.toxic == 0]
    auc = np.mean(bad.score.to_numpy()[:, None] > good.score.to_numpy())
    assert auc > 0.97 and bad.predicted.mean() > 0.85 and good.predicted.mean() < 0.01


def test_features_see_disguise_and_nearness():
    lexicon = {"idiot": 3.0, "lowe*": 2.0}
    names = dict(zip(toxicity.NAMES, toxicity.features("You 1d1ot! loweiig SHOUT!! sooo", lexicon), strict=True))
    assert names["disguised"] > 0 and names["near_you"] > 0 and names["beginnings"] > 0
    assert names["shouted"] > 0 and names["shouts"] > 0 and names["stretched"] > 0
    assert toxicity.features(None, lexicon) == toxicity.features("", lexicon)


# ---- pipeline


def test_pipeline_stages(spark, table_folder, docs, rows):
    table = docs
    counts = []
    for name, stage in corpus_pipeline.STAGES:
        result = stage(spark, table, table_folder)
        if name != "bpe":
            assert result.columns == table.columns, name
        table = spark.createDataFrame(result.collect(), result.schema)
        counts.append(table.count())
    assert counts[0] <= len(rows) and counts[1] <= counts[0] and counts[2] == counts[1] and counts[4] == counts[3]
    assert table.filter("not exact or n_tokens <> size(ids)").count() == 0


def test_pipeline_on_an_empty_table(spark, table_folder, empty):
    table = empty
    for _, stage in corpus_pipeline.STAGES:
        table = stage(spark, table, table_folder)
        table = spark.createDataFrame(table.collect(), table.schema)
        assert table.count() == 0


def test_every_operator_is_registered():
    numbers = sorted(int(name[2:].split("_")[0]) for name in REGISTRY)
    assert numbers == list(range(1, 14))
