"""Stored indexes for searches that read less: block-max postings and product-quantised codes."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from twinseek.functions.json import json_contains, json_has_key
from twinseek.operators import ann, blockmax, embed_ledger, heavy, jsonindex, keyword, pq, settings, thinning, vector
from twinseek.session import cut_lineage
from twinseek.sources import sampling


def written_blocks(spark, tmp_path, size):
    rng = random.Random(3)
    words = ["red", "green", "blue", "cat", "dog", "sun", "sea"]
    rows = [(i, 1 if i % 3 == 0 else 2, i, " ".join(["hot"] * rng.randint(0, 6) + rng.choices(words, k=rng.randint(1, 12)))) for i in range(400)]
    rows += [(500, 2, 500, None), (501, 2, 501, "")]
    chunks = spark.createDataFrame(rows, "id long, user_id long, user_document_id long, text string").repartition(4)
    index = cut_lineage(keyword.text_index(chunks, "simple", ["user_document_id"]))
    lines = keyword.postings(index, ["user_document_id"]).unionByName(keyword.chunk_postings(index, ["user_document_id"]))
    lines.write.parquet(f"{tmp_path}/lines")
    blockmax.block_postings(index, ["user_document_id"], size).write.parquet(f"{tmp_path}/blocks")
    return index, spark.read.parquet(f"{tmp_path}/blocks"), spark.read.parquet(f"{tmp_path}/lines")


QUERIES = [
    "hot", "red cat", '"red cat"', '"red cat" sun', "hot or cat dog", 'hot "sea sun" or "dog cat red" blue', "cat -hot", "-hot",
    "zzz", "", "red red", '"hot hot" hot', "hot or hot",
]


@pytest.mark.parametrize("size", [4, 256])
@pytest.mark.parametrize("scoped", [True, False])
def test_blocks_find_what_all_postings_hold(spark, tmp_path, monkeypatch, size, scoped):
    monkeypatch.setattr(blockmax, "FIRST_BLOCKS", 3)
    monkeypatch.setattr(blockmax, "FIRST_POSTINGS", 10)
    index, blocks, lines = written_blocks(spark, tmp_path, size)
    queries = spark.createDataFrame(
        [(i, 1 + i % 2, t) for i, t in enumerate(QUERIES)], "query_id long, user_id long, query_text string"
    )
    for k, known in ((1, None), (7, keyword.vocabulary(index))):
        found, read = blockmax.block_topk(queries, blocks, lines, k, "simple", scoped, known, ["user_document_id"])
        expected = keyword.keyword_topk(queries, index, k, dictionary="simple", scoped=scoped, keep=["user_document_id"])
        columns = ["query_id", "id", "user_document_id", "relevance", "rank"]
        assert sorted(map(tuple, found.select(*columns).collect())) == sorted(map(tuple, expected.select(*columns).collect()))
        assert read.filter("postings_read > postings").count() == 0


def test_smaller_results_read_fewer_postings(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(blockmax, "FIRST_BLOCKS", 2)
    monkeypatch.setattr(blockmax, "FIRST_POSTINGS", 8)
    _, blocks, lines = written_blocks(spark, tmp_path, 4)
    queries = spark.createDataFrame([(1, "hot"), (2, "red")], "query_id long, query_text string")
    read = {}
    for k in (1, 20, 400):
        report = blockmax.block_topk(queries, blocks, lines, k, "simple", False)[1]
        read[k] = {r["query_id"]: (r["postings_read"], r["postings"]) for r in report.collect()}
    for query in (1, 2):
        assert read[1][query][0] < read[20][query][0] < read[400][query][0] == read[400][query][1]


def test_stored_postings_become_blocks_and_vocabulary_without_another_shuffle(spark, tmp_path):
    index, blocks, lines = written_blocks(spark, tmp_path, 4)
    cut = blockmax.blocks_of(lines, ["user_document_id"], 4)
    assert "Exchange" not in cut._jdf.queryExecution().executedPlan().toString()
    held = [b.select("lexeme", "user_id", F.explode(F.arrays_zip("ids", "positions"))) for b in (cut, blocks)]
    assert sorted(map(repr, held[0].collect())) == sorted(map(repr, held[1].collect()))
    words = [sorted(map(tuple, v.collect())) for v in (keyword.postings_vocabulary(lines), keyword.vocabulary(index))]
    assert words[0] == words[1]


def test_lookups_shuffle_little_beyond_what_is_asked(spark, tmp_path, monkeypatch):
    """What the exact joins get: every wanted row, null and repeated keys included, and few others."""
    rows = spark.range(20_000).select(F.concat(F.lit("w"), F.col("id") % 50).alias("lexeme"), "id")
    wanted = rows.filter("id % 100 = 7").select("lexeme", F.col("id").cast("int").alias("id"))
    kept = thinning.thinned(rows, wanted.unionByName(wanted), ["lexeme", "id"])
    assert kept.join(wanted, ["lexeme", "id"], "left_semi").count() == 200 and kept.count() < 220
    assert thinning.thinned(rows, wanted.limit(0), ["lexeme", "id"]).count() == 0

    index, blocks, lines = written_blocks(spark, tmp_path, 4)
    passed = []
    for module in (blockmax, keyword):
        monkeypatch.setattr(module, "thinned", lambda r, w, k: passed.append((k, r.count(), thinning.thinned(r, w, k))) or passed[-1][2])
    queries = spark.createDataFrame([(1, 1, "cat -hot")], "query_id long, user_id long, query_text string")
    expected = sorted(map(tuple, keyword.keyword_topk(queries, index, 3, dictionary="simple").collect()))
    stored = keyword.keyword_topk(queries, index, 3, dictionary="simple", lines=lines)
    assert sorted(map(tuple, stored.collect())) == expected
    key, before, after = passed.pop()
    assert key == ["id"] and after.count() < before
    found = blockmax.block_topk(queries, blocks, lines, 3, "simple")[0]
    assert sorted(map(tuple, found.select(*stored.columns).collect())) == expected
    assert all(kept.count() < n / 4 for _, n, kept in passed)


def test_blocks_are_cut_by_word_tenant_and_size():
    kinds = {"lexeme": ["a"] * 5 + ["b"] * 2, "user_id": [1, 1, 1, 2, 2, 2, 2], "id": list(range(7)), "weight": [3, 2, 2, 1, 1, 9, 1]}
    batch = pa.RecordBatch.from_pydict(kinds | {"positions": [[1]] * 7})
    cut = pa.Table.from_batches(list(blockmax._cut(2, [])([batch])))
    assert cut["ids"].to_pylist() == [[0, 1], [2], [3, 4], [5, 6]]
    assert cut["top"].to_pylist() == [3, 2, 1, 9] and cut["n"].to_pylist() == [2, 1, 2, 2]


def vectors_of(spark, n, d, seed=1):
    """Vectors around some middles; a third of all rows around one of them, some of them equal."""
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(20, d))
    x = middles[np.where(np.arange(n) % 3 == 0, 0, rng.integers(0, 20, n))] + 0.3 * rng.normal(size=(n, d))
    x[5::50] = x[5]
    rows = [(i, [float(v) for v in x[i]]) for i in range(n)]
    return spark.createDataFrame([*rows, (n, None)], "id long, embedding array<float>").repartition(4)


@pytest.mark.parametrize("limits", [{}, {"SHARD_CODES": 100, "BLOCK_QUERIES": 10}])
def test_codes_reach_recall_and_whole_pools_are_exact(spark, tmp_path, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(pq, name, value)
    table = cut_lineage(vectors_of(spark, 1500, 10))
    queries = table.filter("id % 30 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("query_embedding"))
    pq.write_codes(table, ann.train(table, 6, seed=1), str(tmp_path), parts=4)
    index = pq.read_codes(spark, str(tmp_path))
    exact = vector.nearest_batch(queries, table, 10)
    best = {(r["query_id"], r["id"]) for r in exact.collect()}
    found = {(r["query_id"], r["id"]) for r in pq.search(queries, index, 10, 6, 100).collect()}
    assert len(best & found) >= 0.9 * len(best)
    whole = pq.search(queries, index, 10, 6, 1500).withColumn("distance", F.round("distance", 9))
    expected = exact.withColumn("distance", F.round("distance", 9)).select(*whole.columns)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, expected.collect()))
    assert index.codes.selectExpr("max(octet_length(code)) n").first()["n"] == 4
    assert index.codes.count() == 1500
    assert pq.search(queries.limit(0), index, 10, 6, 100).count() == 0


def test_a_whole_pool_is_handed_on_in_bounded_groups(spark, tmp_path, monkeypatch):
    table = cut_lineage(vectors_of(spark, 800, 6))
    queries = table.filter("id % 4 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("query_embedding"))
    pq.write_codes(table, ann.train(table, 3, seed=1), str(tmp_path), parts=2)
    index = pq.read_codes(spark, str(tmp_path))
    largest = 25_000
    lookup = pq._lookup

    def watched(*how):
        search = lookup(*how)

        def checked(key, asking, codes):
            found = search(key, asking, codes)
            assert found.num_rows <= largest
            return found

        return checked

    plain = sorted(map(tuple, pq.search(queries, index, 5, 3, 800).select("query_id", "id", "rank").collect()))
    monkeypatch.setattr(pq, "_lookup", watched)
    monkeypatch.setattr(pq, "FOUND_ROWS", 8_000)
    bounded = pq.search(queries, index, 5, 3, 800).select("query_id", "id", "rank")
    assert sorted(map(tuple, bounded.collect())) == plain


def test_centers_do_not_depend_on_the_order_of_rows(spark):
    table = cut_lineage(vectors_of(spark, 600, 6))
    clusters = ann.train(table, 3, seed=2)
    assigned = cut_lineage(ann.assign(table, clusters))
    books = [pq.train(assigned.repartition(n), clusters, parts=3) for n in (1, 5)]
    assert np.array_equal(books[0].centers, books[1].centers)


def test_fewer_rows_than_centers():
    rows = np.arange(6, dtype=float).reshape(3, 2)
    centers = pq.fitted_centers(rows, 8)
    assert centers.shape == (8, 2)
    assert np.allclose(centers[pq.nearest_center(rows, centers)], rows)


def three_settings():
    user = vector.Scope("user_id", "user_id")
    return [
        settings.Setting("all", 4),
        settings.Setting("own", 7, [user]),
        settings.Setting("narrow", 5, [user], F.col("score") > 1, vector.Range("score", "low", "high"), F.col("low") > 0),
    ]


@pytest.mark.parametrize("limits", [{}, {"pass_rows": 5, "shard_bytes": 400}])
def test_settings_in_one_scan_are_searches_of_their_own(spark, limits):
    table = cut_lineage(
        vectors_of(spark, 200, 6).withColumns(
            {
                "user_id": F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 5),
                "user_document_id": F.col("id") * 2,
                "score": (F.col("id") % 7).cast("double"),
            }
        )
    )
    table = table.withColumn("user_id", F.when(F.col("id") != 7, F.col("user_id")))
    queries = table.filter("id % 8 = 0 or id = 7").select(
        F.col("id").alias("query_id"), "user_id", F.col("embedding").alias("query_embedding"),
        (F.col("score") - 2).alias("low"), (F.col("score") + 2).alias("high"),
    )
    found = settings.nearest_settings(queries, table, three_settings(), **limits).drop("distance")
    user, keep = [vector.Scope("user_id", "user_id")], ["user_document_id"]
    alone = {
        "all": vector.nearest_batch(queries, table, 4, keep=keep),
        "own": vector.nearest_batch(queries, table, 7, user, keep=keep),
        "narrow": vector.nearest_batch(
            queries.filter("low > 0"), table.filter("score > 1"), 5, user, [vector.Range("score", "low", "high")], keep
        ),
    }
    rows = sorted(map(tuple, found.select("name", "query_id", "id", "user_document_id", "rank").collect()))
    expected = [(n, *r) for n, df in alone.items() for r in df.select("query_id", "id", "user_document_id", "rank").collect()]
    assert rows == sorted(expected)
    assert settings.nearest_settings(queries.limit(0), table, three_settings(), **limits).count() == 0
    assert settings.nearest_settings(queries, table.limit(0), three_settings(), **limits).count() == 0


def test_keyword_settings_are_searches_of_their_own(spark):
    texts = ["red cat", "cat dog cat", "red red cat", "dog", "cat", None]
    rows = [(i, i % 3, i, texts[i % 6], i % 4) for i in range(60)]
    chunks = spark.createDataFrame(rows, "id long, user_id long, user_document_id long, text string, n long")
    index = cut_lineage(keyword.text_index(chunks, "simple", ["user_document_id", "n"]))
    queries = spark.createDataFrame([(1, 0, "cat"), (2, 1, "red cat"), (3, None, "dog"), (4, 2, "")], "query_id long, user_id long, query_text string")
    user = vector.Scope("user_id", "user_id")
    own, odd = settings.Setting("own", 6, [user]), settings.Setting("odd", 3, [], F.col("n") % 2 == 1)
    for chosen in ([own, odd], [own]):
        found = settings.keyword_settings(queries, index, chosen, "simple").drop("relevance")
        alone = {
            "own": keyword.keyword_topk(queries, index, 6, dictionary="simple", keep=["user_document_id"]),
            "odd": keyword.keyword_topk(queries, index.filter("n % 2 = 1"), 3, dictionary="simple", scoped=False, keep=["user_document_id"]),
        }
        names = [s.name for s in chosen]
        expected = [(n, *r) for n in names for r in alone[n].select("query_id", "id", "user_document_id", "rank").collect()]
        rows_ = found.select("name", "query_id", "id", "user_document_id", "rank").collect()
        assert sorted(map(tuple, rows_)) == sorted(expected)


def test_json_postings_contain_what_a_parse_finds(spark, tmp_path):
    texts = [
        '{"a": 1, "b": {"c": [1, 2, {"d": null}], "e": "x"}}', '{"a": 1.0, "b": {"c": []}}', '{"a": "1", "k.l": true, "k[": 2}',
        '{"a": -0.0, "b": {}}', '{"a": 0}', '[1, [2, 3], {"a": 1}]', '{"p": [{"n": 1, "m": 2}, {"n": 2, "m": 1}]}',
        '{"p": [{"n": 1}, {"m": 1}]}', "no json", None, "7", '{"s": "' + "y" * 200 + '"}', '{"a": 1e300}', '{"b": [[1, 2], [3]]}', '{"b": [[1], [2]]}',
        '{"a": 12345678901234567890}',
    ]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, meta string")
    jsonindex.write_json(rows, str(tmp_path))
    postings, variants = jsonindex.read_json(spark, str(tmp_path))
    filters = [
        {}, [], {"a": 1}, {"a": 1.0}, {"a": "1"}, {"a": 0}, {"b": {}}, {"b": {"c": []}}, {"b": {"c": [2, 1]}}, {"b": {"c": [{"d": None}]}},
        {"k.l": True}, {"k[": 2}, {"k": 2}, {"p": [{"n": 1, "m": 1}]}, {"p": [{"n": 1, "m": 2}]}, {"p": [{"n": 2}, {"n": 1}]},
        {"s": "y" * 200}, {"s": "y" * 199}, {"a": 1e300}, {"b": [[1, 2]]}, {"b": [[2], [1]]}, [1, [3]], {"a": 1, "b": {"e": "x"}},
        {"a": 12345678901234567890},
    ]
    for wanted in filters:
        found = sorted(r["id"] for r in jsonindex.containing(postings, variants, wanted).collect())
        parsed = rows.filter(json_contains(F.col("meta"), wanted)).collect()
        assert found == sorted(r["id"] for r in parsed), wanted
    for key in ("a", "k.l", "k[", "b", "none"):
        assert {r["id"] for r in jsonindex.having_key(postings, key).collect()} == {
            r["id"] for r in rows.filter(json_has_key(F.col("meta"), key)).collect()
        }
    plan = jsonindex.containing(postings, variants, {"a": 1, "b": {"e": "x"}})._jdf.queryExecution().executedPlan().toString()
    assert "parse_json" not in plan and "PushedFilters" in plan
    assert jsonindex.json_postings(rows.limit(0)).count() == 0


def _counting(broken=()):
    def make():
        def embedder(texts, input_type):
            if any(b in t for t in texts for b in broken):
                raise RuntimeError("no more calls")
            return [[float(len(t)), float(input_type == "search_query")] for t in texts]

        return embedder

    return make


def _refusing():
    def embedder(texts, input_type):
        raise RuntimeError("a call that was not needed")

    return embedder


def test_ledger_embeds_what_is_new(spark, tmp_path):
    rows = spark.createDataFrame(
        [(i, f"text {i % 40}" if i % 9 else None) for i in range(200)] + [(900, "")], "id long, text string"
    ).repartition(3)
    distinct = rows.selectExpr("coalesce(text, '') t").distinct().count()
    folder = str(tmp_path)
    with pytest.raises(Exception, match="no more calls"):
        embed_ledger.embed_new(rows, "text", _counting(["text 7"]), folder, "m1", slice_texts=10)
    done = embed_ledger.ledger(spark, folder).count()
    found, n = embed_ledger.embed_through(rows, "text", _counting(), folder, "m1", slice_texts=10)
    assert n == distinct - done and 0 < done < distinct
    assert {(r["id"], r["embedding"][0]) for r in found.collect()} == {(r["id"], float(len(r["text"] or ""))) for r in rows.collect()}
    again, n = embed_ledger.embed_through(rows, "text", _refusing, folder, "m1")
    assert n == 0 and again.count() == 201
    # another model or input type is another embedding
    assert embed_ledger.embed_new(rows, "text", _counting(), folder, "m2") == distinct
    queries, n = embed_ledger.embed_through(rows, "text", _counting(), folder, "m1", "vector", "search_query")
    assert n == distinct and {r["vector"][1] for r in queries.collect()} == {1.0}
    assert embed_ledger.ledger(spark, folder).count() == 3 * distinct
    assert embed_ledger.embed_through(rows.limit(0), "text", _refusing, folder, "m3")[0].count() == 0


@pytest.mark.parametrize("capacity", [5, 40, 4096])
def test_frequent_values_are_exact(spark, capacity):
    rng = random.Random(capacity)
    values = [f"v{int(rng.paretovariate(0.7)) % 3000}" for _ in range(6000)] + [f"tie{i}" for i in range(40)] * 50 + [None] * 30 + [""] * 10
    rng.shuffle(values)
    table = spark.createDataFrame([(v,) for v in values], "x string").repartition(5)
    counts = {}
    for v in values:
        if v is not None:
            counts[v] = counts.get(v, 0) + 1
    ranked = sorted(counts.items(), key=lambda c: (-c[1], c[0]))
    for top in (1, 3, 25):
        assert [tuple(r) for r in heavy.most_frequent(table, top, capacity).collect()] == ranked[:top]
    summed = {r["val"]: r["n"] for r in heavy.summaries(table.filter("x is not null"), capacity).collect()}
    taken = summed.pop(None)
    assert all(counts[v] - taken <= n <= counts[v] for v, n in summed.items())
    assert all(n <= taken for v, n in counts.items() if v not in summed)
    assert heavy.most_frequent(table.limit(0), 3, capacity).collect() == []


def test_block_sample_opens_a_share_of_the_files(spark, tmp_path):
    path = f"{tmp_path}/table"
    spark.range(20_000).repartition(160, "id").write.parquet(path)
    drawn = sampling.block_sample(spark, path, 0.25)
    read = {r[0].rsplit("/", 1)[1] for r in drawn.select(F.input_file_name()).distinct().collect()}
    files = {f.rsplit("/", 1)[1] for f in spark.read.parquet(path).inputFiles()}
    rows = sorted(r["id"] for r in drawn.collect())
    assert 20 < len(read) < 60 and 0.15 * 20_000 < len(rows) < 0.35 * 20_000
    # what is not drawn is not opened: it may be damaged
    for name in files - read:
        with open(f"{path}/{name}", "r+b") as file:
            file.write(b"damaged!")
            file.seek(-8, 2)
            file.write(b"damaged!")
    schema = spark.range(1).schema
    again = spark.read.schema(schema).parquet(path).filter(sampling._drawn(F.col("_metadata.file_name"), 0.25, 0))
    assert sorted(r["id"] for r in again.collect()) == rows


def test_block_sample_of_few_files(spark, tmp_path):
    path = f"{tmp_path}/table"
    spark.range(20_000).coalesce(1).write.parquet(path)
    assert sampling.block_shares(1, 0.1) == (1.0, 0.1)
    assert sampling.block_shares(64, 0.1) == (0.5, 0.2)
    n = sampling.block_sample(spark, path, 0.1).count()
    assert 1600 < n < 2400 and sampling.block_sample(spark, path, 1).count() == 20_000
    assert sampling.block_sample(spark, path, 0).count() == 0
    with pytest.raises(ValueError, match="no share"):
        sampling.block_sample(spark, path, 2)
