"""Candidates that are dropped inside the tasks change no result."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinseek.operators import candidates, fusion, keyword, ranked
from twinseek.operators.ranking import top_k_per_query
from twinseek.session import cut_lineage

WORDS = ["the", "cat", "dog", "of", "rare", "a", "tree"]
QUERIES = ["the", "cat cat", '"the the"', "the of", "the cat dog", "rare or the", "-cat", "the -dog", '"the cat" of', "zzz the", "", '-rare or "of a"']


def tables(spark):
    texts = [" ".join(WORDS[(i * 7 + j * j * (i % 5 + 1)) % 6 + (i % 97 == 0)] for j in range(3 + i % 6)) for i in range(400)]
    # many copies of one line, which all match alike
    texts += ["the cat of the dog the the cat"] * 60
    rows = [(1000 - i, 1 + i % 2, t) for i, t in enumerate(texts)] + [(2000, None, "the cat")]
    chunks = spark.createDataFrame(rows, "id long, user_id long, text string")
    asked = [(i % 20, 1 + i % 2, q) for i, q in enumerate(QUERIES * 2)] + [(50, None, "the")]
    return cut_lineage(keyword.text_index(chunks, "simple")), spark.createDataFrame(asked, "query_id long, user_id long, query_text string")


@pytest.mark.parametrize("scoped", [True, False])
def test_the_best_are_among_those_handed_on(spark, monkeypatch, scoped):
    monkeypatch.setattr(candidates, "BATCH_ROWS", 100)
    monkeypatch.setattr(candidates, "PAIRS", 64)
    index, queries = tables(spark)
    every = cut_lineage(keyword.keyword_matches(queries, index, "simple", scoped))
    fewer = {small: keyword.keyword_matches(queries, index, "simple", scoped, small=small, best=3) for small in (True, False)}
    columns = ["query_id", "id", "relevance", "rank"]
    expected = sorted(map(tuple, top_k_per_query(every, "relevance", 3, descending=True).select(*columns).collect()))
    for found in fewer.values():
        assert sorted(map(tuple, top_k_per_query(found, "relevance", 3, descending=True).select(*columns).collect())) == expected
    assert fewer[False].count() < every.count() / 2


def test_only_chunks_with_all_words_leave_the_task(spark):
    index, _ = tables(spark)
    queries = spark.createDataFrame([(1, "the rare tree")], "query_id long, query_text string")
    leads = cut_lineage(keyword.anchors(keyword.compile_queries(queries, "simple")).withColumn("lead", F.lit(0).cast("long")))
    found = candidates.candidates(leads, index, False)
    words = [{w["lexeme"] for w in r["text_search_vector"]} for r in found.collect()]
    held = index.filter(F.size(F.array_intersect("text_search_vector.lexeme", F.array(F.lit("the"), F.lit("rare"), F.lit("tree")))) == 3)
    assert len(words) == held.count()
    assert all(w == {"the", "rare", "tree"} for w in words)


def test_repeated_chunks_meet_each_other_in_the_shuffled_form(spark):
    chunks = spark.createDataFrame([(1, 1, "the cat"), (1, 1, "the cat"), (2, 1, "the cat")], "id long, user_id long, text string")
    queries = spark.createDataFrame([(1, 1, "cat")], "query_id long, user_id long, query_text string")
    index = cut_lineage(keyword.text_index(chunks, "simple"))
    found = keyword.keyword_matches(queries, index, "simple", small=False, best=5)
    assert sorted(r["id"] for r in found.collect()) == [1, 1, 1, 1, 2]


KINDS = [
    "the cat", "the cat dog", 'the or "cat dog"', '"the cat" the', '"the cat" or "cat the" or of', "the of or cat dog -rare", '"the the" or the',
    "the or cat or dog", '-"the cat" of', '-the or -cat or "of dog"', '"the of cat"', "a or the a", '"cat dog" cat dog',
]


def lines_of_words(n):
    """Lines of few words in all orders, some long, some alike."""
    state = 7
    for i in range(n):
        words = []
        for _ in range(1 + i % 40):
            state = (state * 1103515245 + 12345) % (1 << 31)
            words.append(WORDS[(state >> 16) % 7 if i % 3 else (state >> 16) % 3])
        yield " ".join(words)


@pytest.mark.parametrize("k", [2, 1000])
def test_matches_ranked_in_the_tasks_have_the_relevance_of_the_expressions(spark, monkeypatch, k):
    for name, value in {"WORDS": 200, "CELLS": 300, "STEP": 50}.items():
        monkeypatch.setattr(ranked, name, value)
    monkeypatch.setattr(candidates, "BATCH_ROWS", 70)
    chunks = spark.createDataFrame([(i * 37 % 500, 1, t) for i, t in enumerate(lines_of_words(500))], "id long, user_id long, text string")
    index = cut_lineage(keyword.text_index(chunks, "simple").repartition(2))
    # every text is asked twice
    queries = spark.createDataFrame([(i, 1, q) for i, q in enumerate(KINDS * 2)], "query_id long, user_id long, query_text string")
    every = keyword.keyword_matches(queries, index, "simple")
    expected = sorted(map(tuple, top_k_per_query(every, "relevance", k, descending=True).select("query_id", "id", "relevance", "rank").collect()))
    found = keyword.keyword_topk(queries, index, k, dictionary="simple").select("query_id", "id", "relevance", "rank")
    assert sorted(map(tuple, found.collect())) == expected


@pytest.mark.parametrize("small", [True, False])
def test_a_task_hands_on_no_more_than_the_best(spark, monkeypatch, small):
    monkeypatch.setattr(candidates, "BATCH_ROWS", 100)
    chunks = spark.createDataFrame([(i, 1, t) for i, t in enumerate(lines_of_words(600))], "id long, user_id long, text string")
    index = cut_lineage(keyword.text_index(chunks, "simple").repartition(2))
    queries = spark.createDataFrame([(1, "the cat"), (2, "cat or the"), (3, "-zzz")], "query_id long, query_text string")
    leads = cut_lineage(keyword.anchors(keyword.compile_queries(queries, "simple")).withColumn("lead", F.monotonically_increasing_id()))
    assert candidates.candidates(leads, index, False, small, best=3).count() <= leads.count() * 3 * 2


def test_what_a_task_holds_back_is_bounded_and_no_match_is_lost(spark, monkeypatch):
    monkeypatch.setattr(ranked, "HELD_ROWS", 4)
    monkeypatch.setattr(candidates, "BATCH_ROWS", 50)
    index, queries = tables(spark)
    every = cut_lineage(keyword.keyword_matches(queries, index, "simple"))
    columns = ["query_id", "id", "relevance", "rank"]
    expected = sorted(map(tuple, top_k_per_query(every, "relevance", 3, descending=True).select(*columns).collect()))
    found = keyword.keyword_topk(queries, index, 3, dictionary="simple").select(*columns)
    assert sorted(map(tuple, found.collect())) == expected


def test_relevance_is_rounded_as_spark_rounds_it(spark):
    values = [0.1 / (1 + n) for n in range(2100)] + [0.1 / 512 + 0.1 / (1 + n) for n in range(600)]
    table = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, raw double")
    found = table.orderBy("i").select((F.round("raw", 9) * 10**9).alias("r")).collect()
    assert ranked.rounded(np.array(values)).tolist() == [round(r["r"]) for r in found]


def test_owners_of_measured_size_travel_to_the_chunks(spark, monkeypatch):
    chunks = spark.range(100).select(F.col("id"), (F.col("id") % 7).alias("user_document_id"), F.lit(1).alias("user_id"))
    documents = spark.range(5).select("id", (F.col("id") + 10).alias("user_id"))
    found = fusion.owned(chunks, documents)
    assert "rightHint=(strategy=broadcast)" in found._jdf.queryExecution().optimizedPlan().toString()
    assert {(r["user_document_id"], r["user_id"]) for r in found.collect()} == {(d, d + 10) for d in range(5)}
    monkeypatch.setattr(fusion, "OWNER_ROWS", 1)
    assert "strategy=broadcast" not in fusion.owned(chunks, documents)._jdf.queryExecution().optimizedPlan().toString()
