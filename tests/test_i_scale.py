"""Work that grew faster than the tables, on rows made here."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from twinseek.functions import json as js
from twinseek.operators import ann, blockmax, candidates, keyword, pq, settings, vector
from twinseek.plans import suite
from twinseek.session import cut_lineage
from twinseek.sources import corpus as cp


@pytest.fixture
def tables(spark, tmp_path):
    texts = [(0, "first\nsecond\nthird"), (1, "only"), (1, "only again\nmore"), (2, None), (3, "\nafter")]
    rows = [(d, t, "en", "src0", 1) for d, t in texts]
    spark.createDataFrame(rows, cp.SCHEMAS["documents"]).write.parquet(f"{tmp_path}/documents.parquet")
    vectors = [(0, [1.0, 0.0], 0), (0, [0.5, 0.5], 0), (1, [0.0, 1.0], 0), (9, [1.0, 1.0], 0)]
    spark.createDataFrame(vectors, cp.SCHEMAS["embeddings"]).write.parquet(f"{tmp_path}/embeddings.parquet")
    return str(tmp_path)


def test_only_first_lines_meet_the_embeddings(spark, tables):
    rows = cp.chunks(spark, tables)
    found = sorted((r["user_document_id"], r["paragraph_id"], r["text"], r["embedding"] and tuple(r["embedding"])) for r in rows.collect())
    assert found == sorted(
        [
            (0, 0, "first", (0.5, 0.5)), (0, 0, "first", (1.0, 0.0)), (0, 1, "second", None), (0, 2, "third", None),
            (1, 0, "only", (0.0, 1.0)), (1, 0, "only again", (0.0, 1.0)), (1, 1, "more", None), (3, 0, "", None), (3, 1, "after", None),
        ],
        key=lambda r: (*r[:3], r[3] or ()),
    )
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    # the lines on the join's side are those of number 0; the others go round it
    assert plan.splitlines()[0].startswith("Union") or "Union" in plan
    assert "paragraph_id" not in next(line for line in plan.splitlines() if "Join" in line)


def test_a_group_starts_from_its_rarest_word_of_the_batch():
    """The anchor is in every chunk and the other word in one: one pair is looked at, not one for every chunk."""
    entry = pa.struct([("lexeme", pa.string()), ("positions", pa.list_(pa.int32()))])
    vectors = [[{"lexeme": "common", "positions": [1]}] for _ in range(50)] + [
        [{"lexeme": "common", "positions": [1]}, {"lexeme": "rare", "positions": [2]}]
    ]
    rows = pa.table({"id": list(range(51)), "scope": [""] * 51, "text_search_vector": pa.array(vectors, pa.list_(entry))})
    leads = pa.table({"lead": [7, 8], "scope": ["", ""], "words": [["common", "rare"], ["common"]], "lexemes": [["common", "rare"], ["common"]]})
    asked = candidates.Asked(leads)
    started = []
    holding = asked._holding
    asked._holding = lambda *a: started.extend(a[-1].tolist()) or holding(*a)
    entries = candidates.plain(rows["text_search_vector"]).flatten()
    found = [pair for lead, row in asked.pairs(rows, entries) for pair in zip(lead.tolist(), row.tolist(), strict=True)]
    assert started == [1, 51]
    assert sorted(found) == [(0, 50), *[(1, i) for i in range(51)]]


def test_settings_that_ask_the_same_are_searched_once(spark):
    rows, filters = suite.matrix(), {"position": "middle"}
    for asked in suite.matrix_settings(rows, filters):
        merged, _ = settings._shared(asked)
        assert (len(asked), len(merged)) == (10, 8)
        assert {s.name: s.k for s in merged}["Vector/denorm/user_id" if asked[0].name.startswith("V") else "Text/denorm/user_id"] == 20
    table = spark.range(60).select(
        "id", (F.col("id") % 3).alias("user_id"), (F.col("id") * 2).alias("user_document_id"),
        F.array(*[F.cos(F.col("id") * i).cast("float") for i in (1, 2)]).alias("embedding"),
    )
    queries = table.filter("id % 7 = 0").select(F.col("id").alias("query_id"), "user_id", F.col("embedding").alias("query_embedding"))
    user = vector.Scope("user_id", "user_id")
    odd = F.col("id") % 2 == 1
    chosen = [settings.Setting("few", 2, [user], odd), settings.Setting("all", 3), settings.Setting("many", 9, [user], odd)]
    found = settings.nearest_settings(queries, table, chosen)
    alone = {
        "few": vector.nearest_batch(queries, table.filter(odd), 2, [user]),
        "all": vector.nearest_batch(queries, table, 3),
        "many": vector.nearest_batch(queries, table.filter(odd), 9, [user]),
    }
    expected = [(n, *r) for n, df in alone.items() for r in df.select("query_id", "id", "rank").collect()]
    assert sorted(map(tuple, found.select("name", "query_id", "id", "rank").collect())) == sorted(expected)


def test_a_known_bound_spares_the_selection(monkeypatch):
    random = np.random.default_rng(3)
    x, q = random.normal(size=(4000, 8)), random.normal(size=(5, 8))
    best = vector.TopRows(np.arange(5), 6, ["id"])
    selected = []
    partition = np.partition
    monkeypatch.setattr(np, "partition", lambda a, *rest, **how: selected.append(a.shape[1]) or partition(a, *rest, **how))
    for at in range(0, 4000, 1000):
        rows = np.arange(at, at + 1000)
        best.add(-(x[rows] @ q.T), rows[None, :], np.arange(5), x[rows], q)
        best.settle()
    assert selected == [5]
    found = best.batch()
    order = np.argsort(-(x @ q.T), axis=0, kind="stable")[:6]
    assert found["id"].to_numpy().reshape(5, 6).tolist() == order.T.tolist()


def test_a_value_is_parsed_once_for_all_parts_of_a_condition(spark):
    rows = spark.createDataFrame([(1, '{"a": 1, "b": {"c": true}}'), (2, '{"a": 1}'), (3, "no json"), (4, None)], "id long, meta string")
    wanted = js.json_contains(F.col("meta"), {"a": 1, "b": {"c": True}})
    found = rows.select("id", wanted.alias("held"))
    assert {r["id"]: r["held"] for r in found.collect()} == {1: True, 2: False, 3: False, 4: None}
    expression = found._jdf.queryExecution().optimizedPlan().toString().split("LogicalRDD")[0]
    # one null check and one parse
    assert expression.count("meta#") == 2


def test_words_of_a_chunk_are_put_together_once_for_all_queries(spark, tmp_path, monkeypatch):
    """A chunk that many queries choose is looked up once, not once for every one of them."""
    chunks = spark.createDataFrame([(i, 1, f"common w{i % 4} v{i % 3}") for i in range(48)], "id long, user_id long, text string")
    index = cut_lineage(keyword.text_index(chunks, "simple"))
    lines = cut_lineage(keyword.postings(index).unionByName(keyword.chunk_postings(index)))
    blocks = cut_lineage(blockmax.block_postings(index))
    asked = [(q, 1, f"common w{q % 4}") for q in range(40)] + [(q, 1, f"w{q % 4} v{q % 3}") for q in range(40, 60)]
    queries = spark.createDataFrame(asked, "query_id long, user_id long, query_text string")
    met = []
    original = candidates.candidates
    monkeypatch.setattr(blockmax, "candidates", lambda leads, rows, *rest: met.append((leads.count(), rows.count())) or original(leads, rows, *rest))
    found = blockmax.block_topk(queries, blocks, lines, 5, "simple")[0]
    expected = keyword.keyword_topk(queries, index, 5, dictionary="simple")
    columns = ["query_id", "id", "relevance", "rank"]
    assert sorted(map(tuple, found.select(*columns).collect())) == sorted(map(tuple, expected.select(*columns).collect()))
    # distinct texts, and chunks, however many queries chose them
    assert met[0][0] <= 16 and met[0][1] <= 48


@pytest.mark.parametrize("limits", [{}, {"WHOLE_CODES": 20, "WHOLE_QUERIES": 7}])
def test_a_pool_of_every_code_is_ranked_where_the_vectors_are(spark, tmp_path, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(pq, name, value)
    random = np.random.default_rng(5)
    x = random.normal(size=(300, 6))
    x[100:110] = x[7]
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)]
    table = cut_lineage(spark.createDataFrame(rows, "id long, embedding array<float>").repartition(3))
    queries = table.filter("id % 15 = 7").select(F.col("id").alias("query_id"), F.col("embedding").alias("query_embedding"))
    pq.write_codes(table, ann.train(table, 4, seed=1), str(tmp_path), parts=3)
    index = pq.read_codes(spark, str(tmp_path))
    handed = []
    original = pq._search_whole
    monkeypatch.setattr(pq, "_search_whole", lambda *a: handed.append(original(*a)) or handed[-1])
    found = pq.search(queries, index, 5, 4, 300).withColumn("distance", F.round("distance", 9))
    expected = vector.nearest_batch(queries, table, 5).withColumn("distance", F.round("distance", 9)).select(*found.columns)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, expected.collect()))
    # k rows a query and group leave a group, where every pair did
    groups = 4 if not limits else sum(-(-r["count"] // 20) for r in index.codes.groupBy("cluster").count().collect())
    assert handed[0].count() <= queries.count() * groups * 5
    # with smaller pools both forms stand beside each other
    sizes = sorted(r["count"] for r in index.codes.groupBy("cluster").count().collect())
    mixed = pq.search(queries, index, 5, 1, sizes[1])
    assert mixed.groupBy("query_id").count().filter("count <> 5").count() == 0 and mixed.select("query_id").distinct().count() == queries.count()
