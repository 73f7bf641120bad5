"""Every embedding is searched or reported."""

from twinseek.registry import queries
from twinseek.sources import corpus as cp


def test_every_vector_is_searched_or_reported(spark, folder):
    searched = cp.chunks(spark, folder, embedded_only=True).select("user_document_id").collect()
    reported = queries.REGISTRY["vectors_without_text"](spark, folder).collect()
    every = sorted(r[0] for r in cp.table(spark, folder, "embeddings").select("vec_id").collect())
    assert sorted([r[0] for r in searched] + [r["vec_id"] for r in reported]) == every


def test_reasons(spark, tmp_path):
    documents = [(1, "one\ntwo", "en", "s", 7), (2, None, "en", "s", None), (3, None, "en", "s", 0), (3, "three", "en", "s", 5)]
    vectors = [(i, [float(i or 0)], 0) for i in (1, 2, 3, 4, 4, None)]
    for name, rows in (("documents", documents), ("embeddings", vectors)):
        spark.createDataFrame(rows, cp.SCHEMAS[name]).write.parquet(f"{tmp_path}/{name}.parquet")
    found = cp.vectors_without_text(spark, str(tmp_path)).select("vec_id", "reason").collect()
    want = [(2, "no text"), (4, "no document"), (4, "no document"), (None, "no document")]
    assert sorted(map(tuple, found), key=repr) == sorted(want, key=repr)
