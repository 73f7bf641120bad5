"""The lexicon of toxicity counts all labelled rows, however they are partitioned."""

import math

import pytest
from pyspark.sql import functions as F

from twinseek.llm import toxicity


def test_a_term_outside_the_sample_is_learned(spark):
    ids = spark.range(400).select(F.col("id").alias("doc_id"))
    labels = ids.withColumn("toxic", (F.col("doc_id") % 2).cast("int"))
    plain = ids.withColumn("text", F.concat_ws(" ", F.lit("some words"), F.col("doc_id").cast("string")))
    drawn = {r["doc_id"] for r in toxicity.examples(plain, toxicity.learnable_labels(labels), 20).select("doc_id").collect()}
    free = ids.filter(~toxicity.held_out(F.col("doc_id")) & (F.col("doc_id") % 2 == 1)).collect()
    rare = [r["doc_id"] for r in free if r["doc_id"] not in drawn][:40]
    docs = plain.withColumn("text", F.when(F.col("doc_id").isin(rare), F.concat("text", F.lit(" blorgh"))).otherwise(F.col("text")))
    assert len(rare) == 40
    assert "blorgh" in toxicity.train(docs, labels, 20).lexica.value[2]


def plain_lexicon(rows, folds):
    sizes = {label: sum(1 for _, f, t in rows if t == label and f in folds) for label in (0, 1)}
    counts = {}
    for text, fold, toxic in rows:
        if fold in folds:
            for term in toxicity.terms_of(set(toxicity.plain_words(text))):
                counts.setdefault(term, [0, 0])[toxic] += 1
    found = []
    for term, (good, bad) in counts.items():
        odds = math.log((bad + 0.5) / (sizes[1] + 1)) - math.log((good + 0.5) / (sizes[0] + 1))
        if bad >= toxicity.LEAST_DOCUMENTS and odds >= toxicity.LEAST_ODDS:
            found.append((-bad * odds, term, odds))
    return dict.fromkeys(toxicity.KNOWN, toxicity.KNOWN_ODDS) | {t: o for _, t, o in sorted(found)[: toxicity.TERMS]}


@pytest.mark.parametrize("parts", [1, 4, 50])
@pytest.mark.parametrize("held", [50, 1 << 18])
def test_lexicon_is_a_plain_count_over_any_partitions(spark, monkeypatch, parts, held):
    monkeypatch.setattr(toxicity, "HELD_TERMS", held)
    rows = [(f"plain words of number {i % 90} blorgh", i % 2, 0) for i in range(400)]
    rows += [(f"blorgh zonk{i % 3} words {'vermo' if i % 2 else 'snarf'}{i % 5}", i % 2, 1) for i in range(120)]
    table = spark.createDataFrame([(t, f, float(x)) for t, f, x in rows], "text string, fold int, toxic double")
    for found, folds in zip(toxicity.lexicons(table.repartition(parts)), ((0,), (1,), (0, 1)), strict=True):
        expected = plain_lexicon(rows, folds)
        assert found.keys() == expected.keys() and "zonk1" in found and "blorgh" not in found
        assert all(math.isclose(found[t], expected[t], rel_tol=1e-9) for t in expected)
