"""Small fixtures against hand-made results or brute force, including skewed groups."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from twinseek.operators import ann, embed, enrich, evalset, fusion, ingest, keyword, metrics, quality, ranking, vector
from twinseek.plans import search, suite
from twinseek.session import cut_lineage
from twinseek.sources import evalfiles, layout, timing

RNG = np.random.default_rng(5)


def vectors_table(spark, n=300, d=8, tenants=4):
    """A third of the rows belongs to tenant 1, and every tenth vector is a copy."""
    x = RNG.normal(size=(n, d)).astype(np.float32)
    x[9::10] = x[0]
    owner = [1 if i % 3 == 0 else 2 + i % (tenants - 1) for i in range(n)]
    rows = [(i, owner[i], i // 5, [float(v) for v in x[i]], float(i % 7)) for i in range(n)]
    table = spark.createDataFrame(
        rows, "id long, user_id long, user_document_id long, embedding array<float>, score double"
    ).repartition(5)
    return table, x.astype(np.float64), owner


def brute(x, ids, q, k):
    order = sorted(ids, key=lambda i: (-round(float(x[i] @ q), 12), i))
    return order[:k]


@pytest.mark.parametrize("limits", [{}, {"pass_rows": 7}, {"pass_bytes": 1000}])
def test_nearest_batch_equals_brute_force(spark, limits):
    table, x, owner = vectors_table(spark)
    queries = table.filter("id % 9 = 0").select(
        F.col("id").alias("query_id"), "user_id", F.col("embedding").alias("query_embedding")
    )
    found = vector.nearest_batch(queries, table, 6, [vector.Scope("user_id", "user_id")], keep=["user_document_id"], **limits)
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        assert r["user_document_id"] == r["id"] // 5
        got.setdefault(r["query_id"], []).append(r["id"])
    for q in range(0, 300, 9):
        mine = [i for i in range(300) if owner[i] == owner[q]]
        assert got[q] == brute(x, mine, x[q], 6)


def test_nearest_batch_with_ranges_and_nulls(spark):
    table, x, _ = vectors_table(spark)
    queries = spark.createDataFrame(
        [(1, [float(v) for v in x[4]], 2.0, 3.0), (2, None, 0.0, 9.0), (3, [float(v) for v in x[5]], 50.0, 60.0)],
        "query_id long, query_embedding array<float>, low double, high double",
    )
    found = vector.nearest_batch(queries, table, 5, ranges=[vector.Range("score", "low", "high")]).orderBy("rank").collect()
    assert [r["id"] for r in found] == brute(x, [i for i in range(300) if 2 <= i % 7 <= 3], x[4], 5)
    empty = vector.nearest_batch(queries.limit(0), table, 5)
    assert empty.columns == ["query_id", "id", "distance", "rank"] and empty.count() == 0


@pytest.mark.parametrize("sizes", [(5, 400), (3, 1 << 20), (1000, 600)])
def test_blocks_and_shards_lose_nothing(spark, sizes):
    """Equal distances, a tenant with a third of the rows, ranges, and queries that come twice, over many shards."""
    table, x, owner = vectors_table(spark)
    queries = table.filter("id % 7 = 0").select(
        F.col("id").alias("query_id"), "user_id", F.col("embedding").alias("query_embedding"),
        (F.col("score") - 2).alias("low"), (F.col("score") + 2).alias("high"),
    )
    queries = queries.unionByName(queries.filter("query_id = 7").withColumn("query_embedding", F.lit(None).cast("array<float>")))
    scope, near = [vector.Scope("user_id", "user_id")], [vector.Range("score", "low", "high")]
    how = {"block_rows": sizes[0], "shard_bytes": sizes[1]}
    for scopes, ranges in (([], []), (scope, []), (scope, near), ([], near)):
        found = vector.nearest_shuffled(queries, table, 6, scopes, ranges, ["user_document_id"], **how)
        expected = vector.nearest_batch(queries, table, 6, scopes, ranges, ["user_document_id"])
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, expected.collect()))
    assert vector.nearest_shuffled(queries.limit(0), table, 6, **how).columns == ["query_id", "id", "distance", "rank"]
    assert vector.nearest_shuffled(queries, table.limit(0), 6, **how).count() == 0


def test_a_bound_spares_rows():
    """With the k-th distance of another shard known, a shard hands on only what can still be among the k nearest."""
    asked = {"query_id": [1], "query_embedding": [[1.0, 0.0]], "scope": [""], "low": [[]], "high": [[]], "bound": [-5.0]}
    kinds = pa.schema(
        [("query_id", pa.int64()), ("query_embedding", pa.list_(pa.float32())), ("scope", pa.string()),
         ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64())), ("bound", pa.float64())]
    )
    shard = pa.table(
        {"id": pa.array(range(10), pa.int64()), "scope": [""] * 10, "ranges": pa.array([[]] * 10, pa.list_(pa.float64())),
         "embedding": pa.array([[float(i), 1.0] for i in range(10)], pa.list_(pa.float32()))}
    )
    search = vector._block_search(8, ["id"], 0)
    assert sorted(search((), pa.table(asked, kinds), shard)["id"].to_pylist()) == [5, 6, 7, 8, 9]
    assert search((), pa.table({**asked, "bound": [float("inf")]}, kinds), shard).num_rows == 8


def test_single_query_agrees_with_batch(spark):
    table, x, _ = vectors_table(spark)
    single = [r["id"] for r in vector.nearest(table, [float(v) for v in x[7]], 8).collect()]
    assert single == brute(x, range(300), x[7], 8)


def test_wrong_width_fails(spark):
    table, _, _ = vectors_table(spark)
    queries = spark.createDataFrame([(1, [1.0, 2.0])], "query_id long, query_embedding array<float>")
    with pytest.raises(Exception, match="expected 2 dimensions"):
        vector.nearest_batch(queries, table, 5).collect()


def keyword_rows(spark):
    rng = random.Random(3)
    words = ["red", "green", "blue", "cat", "dog", "sun", "sea", "sky", "tree", "stone"]
    texts = [" ".join(["hot"] * (i % 3 == 0) + rng.choices(words, k=rng.randint(1, 14))) for i in range(240)]
    rows = [(i, 1 if i % 3 == 0 else 2, i, t) for i, t in enumerate(texts)]
    chunks = spark.createDataFrame(rows, "id long, user_id long, user_document_id long, text string").repartition(4)
    asked = ["hot", "red cat", '"red cat"', "sun or sea -dog", "-red", "hot -cat", "nothing", "", "sky tree stone or hot"]
    queries = spark.createDataFrame(
        [(i, 1 + i % 2, q) for i, q in enumerate(asked)], "query_id long, user_id long, query_text string"
    )
    return chunks, queries


def pairs(df):
    return sorted((r["query_id"], r["id"], r["relevance"]) for r in df.collect())


@pytest.mark.parametrize("scoped", [True, False])
def test_keyword_plans_agree(spark, scoped):
    chunks, queries = keyword_rows(spark)
    index = cut_lineage(keyword.text_index(chunks, "simple"))
    lines = keyword.postings(index).unionByName(keyword.chunk_postings(index))
    base = pairs(keyword.keyword_matches(queries, index, "simple", scoped, small=True))
    assert len(base) > 200
    assert base == pairs(keyword.keyword_matches(queries, index, "simple", scoped, small=False))
    assert base == pairs(keyword.keyword_matches(queries, index, "simple", scoped, lines=lines))
    assert base == pairs(keyword.keyword_matches(queries, index, "simple", scoped, lines=lines, small=False))
    assert base == pairs(
        keyword.keyword_matches(queries, index, "simple", scoped, known=keyword.vocabulary(index), small=True)
    )
    # each pair once, although a chunk can satisfy several groups
    assert len({p[:2] for p in base}) == len(base)


def test_rrf_variants(spark):
    text = spark.createDataFrame([(1, 10, 1, 0.3), (1, 20, 2, 0.2)], "query_id long, id long, rank long, relevance double")
    semantic = spark.createDataFrame([(1, 20, 1, -0.9), (1, 30, 2, -0.8)], "query_id long, id long, rank long, distance double")
    fused = fusion.fuse(text, semantic)
    scored = ranking.top_k_per_query(fusion.rrf_scores(fused, 50), "score", 10, descending=True).orderBy("rank").collect()
    assert [(r["id"], r["score"]) for r in scored] == [
        (20, pytest.approx(1 / 52 + 1 / 51)), (10, pytest.approx(1 / 51)), (30, pytest.approx(1 / 52)),
    ]
    missing = {r["id"]: r["score"] for r in fusion.rrf_scores(fused, 60, missing_rank=1000).collect()}
    assert missing[10] == pytest.approx(1 / 61 + 1 / 1060) and missing[30] == pytest.approx(1 / 62 + 1 / 1060)
    zero = {r["id"]: r["score"] for r in fusion.rrf_scores(fused, 50, semantic_weight=0.0).collect()}
    assert zero[30] == 0.0 and len(zero) == 3


def test_document_filter_comes_after_the_pool(spark):
    pool = spark.createDataFrame(
        [(1, 1, 100, 1), (1, 2, 200, 2)], "query_id long, id long, user_document_id long, rank long"
    )
    documents = spark.createDataFrame([(200, '{"ok": true}'), (300, '{"ok": true}'), (100, '{"ok": false}')], "id long, meta string")
    kept = fusion.keep_documents(pool, documents, {"ok": True}, 2).collect()
    assert [(r["id"], r["rank"]) for r in kept] == [(2, 1)]


def small_corpus(spark):
    rows = [
        (1, 1, 100, 0, "red cat", [1.0, 0.0], '{"a": 1}'), (2, 1, 100, 1, "green cat", [0.8, 0.6], '{"a": 2}'),
        (3, 1, 101, 0, "blue dog", [0.0, 1.0], '{"a": 1}'), (4, 2, 102, 0, "red dog", [1.0, 0.0], '{"a": 1}'),
        (5, 1, 103, 0, "cat cat cat", None, '{"a": 1}'),
    ]
    chunks = spark.createDataFrame(
        rows,
        "id long, user_id long, user_document_id long, paragraph_id long, text string, embedding array<float>, meta string",
    ).withColumn("created_at", F.lit("2024-03-01 00:00:00").cast("timestamp"))
    documents = spark.createDataFrame(
        [(100, 1, "A", '{"k": "x"}'), (101, 1, "B", '{"k": "y"}'), (102, 2, "C", '{"k": "x"}'), (103, 1, "D", '{"k": "x"}')],
        "id long, user_id long, title string, meta string",
    )
    text = keyword.text_index(chunks, "simple", ["user_document_id", "meta", "created_at"])
    return fusion.Corpus(chunks, documents, text, chunks, "simple")


def test_searcher(spark):
    s = search.Searcher(spark, small_corpus(spark))
    assert [r["id"] for r in s.vector_search(1, [1.0, 0.0], 2).collect()] == [1, 2]
    assert [(r["id"], r["relevance"]) for r in s.text_search(1, "cat").collect()] == [(5, pytest.approx(0.3)), (1, 0.1), (2, 0.1)]
    both = s.hybrid_search(1, [1.0, 0.0], "cat").collect()
    assert [r["chunk_id"] for r in both] == [1, 2, 5, 3]
    assert both[0]["k_score"] == pytest.approx(1 / 52) and both[0]["v_score"] == pytest.approx(1 / 51)
    only = s.hybrid_search(1, [1.0, 0.0], "cat", chunk_meta_filter={"a": 1}, doc_meta_filter={"k": "x"}).collect()
    assert [r["chunk_id"] for r in only] == [1, 5]
    assert [r["chunk_id"] for r in s.hybrid_search(1, [0.0, 1.0], "  ").collect()] == [3, 2, 1]
    assert s.hybrid_search(1, None, "").count() == 0
    with pytest.raises(ValueError, match="tenant"):
        s.vector_search(0, [1.0, 0.0])


def test_requests(spark):
    s = search.Searcher(spark, small_corpus(spark))
    rows = s.execute(search.SearchRequest("cat", search_type="keyword", user_id=1, limit=2)).collect()
    assert [(r["chunk_id"], r["score"], r["text_rank"], r["vector_rank"]) for r in rows] == [(5, 1.0, 1, None), (1, 0.5, 2, None)]
    for bad in (
        search.SearchRequest("cat", search_type="keyword"), search.SearchRequest("", search_type="keyword", user_id=1),
        search.SearchRequest("cat", search_type="semantic", user_id=1), search.SearchRequest("cat", user_id=1),
        search.SearchRequest("cat", search_type="keyword", user_id=1, limit=101),
    ):
        with pytest.raises(ValueError):
            s.execute(bad)
    response = s.search(search.SearchRequest("cat", [1.0, 0.0], "hybrid", 2, user_id=1)).first()
    assert response["total_results"] == 2 and [r["chunk_id"] for r in response["results"]] == [1, 2]
    nothing = s.search(search.SearchRequest("zzz", search_type="keyword", user_id=1)).first()
    assert nothing["total_results"] == 0 and nothing["results"] == []
    parents = s.search_with_parents(search.SearchRequest("cat", [1.0, 0.0], "hybrid", user_id=1)).orderBy("rank").collect()
    assert [r["document"]["title"] for r in parents] == ["A", "A", "D", "B"]


def test_parent_guard(spark):
    corpus = small_corpus(spark)
    results = spark.createDataFrame([(1, 1, 102, 1), (1, 1, 100, 2)], "query_id long, user_id long, document_id long, rank long")
    parents = enrich.fetch_parents(results, corpus.documents)
    assert [r["id"] for r in parents.collect()] == [100]
    joined = enrich.enrich(results, parents).orderBy("rank").collect()
    assert joined[0]["document"] is None and joined[1]["document"]["title"] == "A"


def test_layout_round_trip(spark, tmp_path):
    corpus = small_corpus(spark)
    layout.write_corpus(corpus.documents, corpus.chunks, str(tmp_path), "simple", buckets=4)
    stored = layout.read_corpus(spark, str(tmp_path), use_postings=True, use_vocabulary=True)
    assert stored.user_buckets == 4 and stored.dictionary == "simple"
    for other in ({"buckets": 8}, {"dictionary": "english"}):
        with pytest.raises(ValueError, match="was written with"):
            layout.read_corpus(spark, str(tmp_path), **other)
    a = search.Searcher(spark, corpus).hybrid_search(1, [1.0, 0.0], "cat").collect()
    b = search.Searcher(spark, stored).hybrid_search(1, [1.0, 0.0], "cat").collect()
    assert [(r["chunk_id"], r["score"]) for r in a] == [(r["chunk_id"], r["score"]) for r in b]
    plan = search.Searcher(spark, stored)._tenant(stored.chunks, 1)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(user_bucket" in plan


def test_row_numbers_in_blocks(spark):
    """One group holds most rows and spans many blocks."""
    df = spark.createDataFrame([("big" if i % 4 else f"g{i}", i) for i in range(400)], "g string, o long").repartition(7)
    rows = ranking.blocked_row_number(df, [F.col("o")], F.floor(F.col("o") / 16), ["g"], total="n").orderBy("o").collect()
    seen = {}
    for r in rows:
        seen[r["g"]] = seen.get(r["g"], 0) + 1
        assert r["row_number"] == seen[r["g"]]
    assert all(r["n"] == seen[r["g"]] for r in rows)


@pytest.mark.parametrize("n, p95, p99", [(30, 28, 30), (100, 95, 99), (1, 1, 1), (2, 1, 2), (1000, 950, 990)])
def test_percentile_rule(spark, n, p95, p99):
    df = spark.createDataFrame([("a", float(i)) for i in range(1, n + 1)], "k string, x double").repartition(3)
    r = ranking.order_statistics(df, ["k"], "x").first()
    assert (r["n"], r["median"], r["p95"], r["p99"]) == (n, (n + 1) / 2, p95, p99)


def test_percentiles_with_repeats_and_groups(spark):
    values = [("a", float(i % 5)) for i in range(203)] + [("b", 7.0)] * 50
    rows = {r["k"]: r for r in ranking.order_statistics(spark.createDataFrame(values, "k string, x double"), ["k"], "x").collect()}
    a = sorted(x for k, x in values if k == "a")
    assert rows["a"]["median"] == a[101] and rows["a"]["p95"] == a[int(203 * 0.95) - 1] and rows["a"]["p99"] == a[int(203 * 0.99) - 1]
    assert rows["b"]["median"] == rows["b"]["p95"] == 7.0


@pytest.mark.parametrize("cap, expected", [(10, [4, 3, 3]), (2, [2, 2, 2])])
def test_even_assignment(spark, cap, expected):
    documents = spark.createDataFrame([(f"u{i}",) for i in range(10)], "url string")
    users = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    dealt = ingest.assign_users(documents, users, cap)
    counts = {r["user_id"]: r["count"] for r in dealt.groupBy("user_id").count().collect()}
    assert [counts[u] for u in (1, 2, 3)] == expected
    again = {r["url"]: r["user_id"] for r in ingest.assign_users(documents.repartition(3), users, cap).collect()}
    assert again == {r["url"]: r["user_id"] for r in dealt.collect()}


def test_fewer_documents_than_users(spark):
    documents = spark.createDataFrame([("a",), ("b",)], "url string")
    users = spark.createDataFrame([(i,) for i in range(1, 6)], "id long")
    assert sorted(r["user_id"] for r in ingest.assign_users(documents, users, 10).collect()) == [1, 2]


def test_ingest_end_to_end(spark):
    items = spark.createDataFrame(
        [(i, f"t{i % 3}", f"text {i}. more!", f"http://x/{i % 3}", i % 3, 1.0, i // 3, 2, [0.5, float(i)]) for i in range(12)],
        "id long, title string, text string, url string, wiki_id long, views double, paragraph_id long, langs int, emb array<float>",
    )
    users = spark.createDataFrame([(1,), (2,)], "id long")
    documents, chunks = ingest.ingest(items, users)
    assert documents.count() == 3 and chunks.count() == 12
    stats = ingest.statistics(users, documents, chunks).first()
    assert (stats["total_chunks"], stats["avg_docs_per_user"]) == (12, 1.5)
    empty = ingest.statistics(users.limit(0), documents, chunks).first()
    assert empty["avg_docs_per_user"] == 0
    positions = [r["position"] for r in chunks.filter("paragraph_id < 4").orderBy("user_document_id", "paragraph_id").collect()]
    assert positions[:4] == ["beginning", "middle", "end", "end"]
    assert quality.orphans(chunks, documents, "user_document_id").count() == 0


def test_validation_splits_rows(spark):
    df = spark.createDataFrame([(1, '{"quality_score": 11}'), (2, '{"quality_score": 5}')], "id long, meta string")
    good, bad = quality.validate(df, quality.meta_rules(F.col("meta"), {"quality_score": (0, 10)}, ["quality_score"]))
    assert [r["id"] for r in good.collect()] == [2]
    assert bad.first()["reasons"] == ["quality_score out of range"]


def test_ground_truth_and_mrr(spark):
    queries = spark.createDataFrame([(1, 10), (2, 20), (3, 30)], "query_id long, ground_truth_chunk_id long")
    results = spark.createDataFrame([(1, 10, 1), (2, 9, 1), (2, 20, 4), (3, 9, 1)], "query_id long, id long, rank long")
    ranks = metrics.ground_truth_ranks(queries, results)
    assert {r["query_id"]: (r["ground_truth_rank"], r["result_count"]) for r in ranks.collect()} == {1: (1, 1), 2: (4, 2), 3: (None, 1)}
    r = ranks.agg(metrics.mrr(F.col("ground_truth_rank")).alias("m"), metrics.recall(F.col("ground_truth_rank")).alias("r")).first()
    assert r["m"] == pytest.approx((1 + 0.25) / 3) and r["r"] == pytest.approx(2 / 3)


def test_sidecar_layouts(spark, tmp_path):
    (tmp_path / "q.csv").write_text(
        "query_id,query_text,ground_truth_chunk_id,ground_truth_document_id,ground_truth_user_id,"
        'ground_truth_paragraph_id,document_title,chunk_text_preview\n1,"a ""b"", c",5,6,7,8,T,p\n2,x,1,1,1,1,T,p\n'
    )
    (tmp_path / "new.json").write_text('{"1": {"query_embedding": [1.0], "document_embedding": [2.0], "meta": {"k": 1}}}')
    (tmp_path / "old.json").write_text('{"1": [1.0, 2.0], "2": [3.0, 4.0]}')
    new = evalfiles.read_evaluation_set(spark, str(tmp_path / "q.csv"), str(tmp_path / "new.json")).orderBy("query_id").collect()
    assert new[0]["query_text"] == 'a "b", c' and new[0]["query_embedding"] == [1.0] and new[0]["meta"] == '{"k":1}'
    assert new[1]["query_embedding"] is None and new[1]["meta"] == "{}"
    old = evalfiles.read_evaluation_set(spark, str(tmp_path / "q.csv"), str(tmp_path / "old.json")).orderBy("query_id").collect()
    assert [r["query_embedding"] for r in old] == [[1.0, 2.0], [3.0, 4.0]]


def test_timing_reports(spark, tmp_path):
    (tmp_path / "a.txt").write_text("Planning Time: 1.5 ms\nx\nTotal Time: 3 ms\nTotal Time: 4 ms\n")
    (tmp_path / "b.txt").write_text("Execution Time: 1 ms\nTotal Time: 2 ms\n")
    (tmp_path / "summary.txt").write_text("Total Time: 9 ms\n")
    (tmp_path / "c.txt").write_text("nothing\n")
    reports = timing.timings(timing.read_reports(spark, str(tmp_path)))
    assert [(r["name"], r["total_time"]) for r in timing.ranked_timings(reports).collect()] == [("b", 2.0), ("a", 4.0)]
    r = timing.timing_range(reports).first()
    assert (r["fastest"], r["slowest"], r["range_ratio"]) == ("b", "a", 2.0)


def test_embedding_batches(spark):
    def make():
        def f(texts, input_type):
            assert len(texts) <= 96
            return [[float(len(t)), 1.0 if input_type == "search_query" else 0.0] for t in texts]

        return f

    df = spark.createDataFrame([(i, "x" * i) for i in range(300)], "query_id long, query_text string").coalesce(1)
    rows = embed.embed_queries(df, make).collect()
    assert all(r["query_embedding"] == [float(r["query_id"]), 1.0] for r in rows)
    assert embed.embed_queries(df.limit(0), make).count() == 0


def test_stored_clusters(spark, tmp_path):
    table, _, _ = vectors_table(spark, 200)
    clusters = ann.train(table, 4, seed=1)
    ann.write_clusters(table, clusters, str(tmp_path))
    stored, again = ann.read_clusters(spark, str(tmp_path))
    assert stored.count() == table.count() and (again.centers == clusters.centers).all() and again.bound == clusters.bound
    plan = stored.filter("cluster = 2")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(cluster" in plan


def test_stream_keys(spark, tmp_path):
    from twinseek.streaming import ingest as stream

    def batch(*rows):
        return stream.features(spark.createDataFrame([(*r, 0, 1, "text", [1.0]) for r in rows], stream.ARRIVING))

    path = str(tmp_path / "chunks")
    one = batch((1, 7, 0), (1, 5, 0), (2, 5, 0), (2, 5, 0), (None, 5, 0), (3, None, 0), (3, 5, None))
    for _ in range(2):
        stream.append_new(one, path, 4)
    stream.append_new(batch((1, 7, 0), (1, 5, 0), (4, 9, 1)), path, 4, 1)
    rows = sorted(map(tuple, spark.read.parquet(path).select("user_document_id", "user_id", "paragraph_id").collect()))
    assert rows == [(1, 5, 0), (2, 5, 0), (4, 9, 1)]
    rejects = spark.read.parquet(f"{path}_rejects").groupBy("batch", "reason").count().collect()
    assert {(r["batch"], r["reason"]): r["count"] for r in rejects} == {
        (0, "no key or tenant"): 3, (0, "key of another tenant"): 1, (1, "key of another tenant"): 1,
    }


def test_known_items_do_not_depend_on_partitions(spark):
    chunks = spark.range(3000).select(
        "id", F.lit(1).alias("user_id"), F.array(F.lit(1.0)).alias("embedding"), F.lit("a b").alias("text"),
        F.lit("{}").alias("meta"), F.col("id").alias("user_document_id"),
    )
    drawn = [sorted(r["id"] for r in evalset.known_items(chunks.repartition(n), 10).collect()) for n in (2, 7)]
    assert drawn[0] == drawn[1] and len(drawn[0]) == 10


@pytest.mark.parametrize(
    ("literal", "json"),
    [
        ("""{'a': 'say "hi"', 'n': 2}""", '{"a": "say \\"hi\\"", "n": 2}'),
        ("{'a': (1, 2), 'b': (3,)}", '{"a": [1, 2], "b": [3]}'),
        ("{'a': True, 'b': None, 'c': 'None (x,)'}", '{"a": true, "b": null, "c": "None (x,)"}'),
        ("""{"a": "it's"}""", """{"a": "it's"}"""),
        ("not a dict", "{}"),
        (None, "{}"),
    ],
)
def test_python_literals_become_json(spark, literal, json):
    found = spark.createDataFrame([(literal,)], "m string").select(evalfiles.meta_json(F.col("m"))).first()[0]
    assert found == json


def test_ann_recall_grows_to_one(spark):
    table, _, _ = vectors_table(spark, 400)
    queries = table.filter("id % 11 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("query_embedding"))
    clusters = ann.train(table, 8, seed=1)
    assigned = cut_lineage(ann.assign(table, clusters))
    exact = vector.nearest_batch(queries, table, 5)
    sweep = {r["probes"]: r["recall"] for r in ann.recall_sweep(queries, assigned, clusters, exact, 5, [1, 4, 8]).collect()}
    assert sweep[1] <= sweep[4] <= sweep[8] == 1.0 and sweep[1] > 0.2


def test_generated_queries(spark):
    documents = spark.createDataFrame(
        [(0, i, 100 + i, 7, 200 + i, 0, "t", "text", None, "{}") for i in range(2)],
        "batch long, doc_idx long, document_id long, user_id long, chunk_id long, paragraph_id long, document_title string, "
        "chunk_text string, embedding array<float>, meta string",
    )
    generated = spark.createDataFrame([(0, ["a", "b", "c", "d", "too many"])], "batch long, queries array<string>")
    rows = evalset.attach_queries(documents, generated).orderBy("query_id").collect()
    assert [(r["query_id"], r["query_text"], r["ground_truth_document_id"]) for r in rows] == [
        (1, "a", 100), (2, "b", 100), (3, "c", 101), (4, "d", 101),
    ]
    assert evalset.attach_queries(documents, generated, 3).count() == 3
    assert evalset.documents_needed(101) == 51


def test_filter_choice_is_typed(spark):
    chunks = spark.createDataFrame([(i, '{"flag": true}' if i % 4 else '{"flag": false}') for i in range(600)], "id long, meta string")
    assert evalset.pick_json_filter(chunks) in ({"flag": True}, {"flag": False})
    assert evalset.pick_json_filter(chunks.limit(50)) is None


def test_matrix_has_seventeen_configurations():
    assert len(suite.matrix()) == 17
    assert len(suite.matrix(False)) == 11


def test_summary_json(spark):
    configs = spark.createDataFrame(
        [("Vector/denorm/user_id", "vector", "user_id", "denorm", 1.234, 500.0)],
        "config string, search_type string, filter_strategy string, schema_design string, avg_ms double, qps double",
    )
    text = evalfiles.summary_json(configs, metrics.run_summary(configs), 30, 10).first()["value"]
    assert '"total_tests":1' in text and '"queries":30' in text and '"best_text_ms":0.0' in text
