"""Embedding a text column with a function the caller brings."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Fixed value: texts per call of the embedding function.
BATCH_SIZE = 96

Embedder = Callable[[Sequence[str], str], Sequence[Sequence[float]]]


def embed(
    df: DataFrame,
    text: str,
    make_embedder: Callable[[], Embedder],
    out: str = "embedding",
    input_type: str = "search_document",
    batch_size: int = BATCH_SIZE,
) -> DataFrame:
    """Adds a vector column. `make_embedder` runs once per Python worker and returns `f(texts, input_type)`.

    Texts reach it in Arrow batches of at most `batch_size`; an empty table makes no call.
    """

    def make_predict():
        embedder = make_embedder()

        def predict(texts: np.ndarray) -> np.ndarray:
            return np.asarray(embedder(["" if t is None else str(t) for t in texts], input_type), dtype=np.float32)

        return predict

    vectorise = predict_batch_udf(make_predict, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size)
    return df.withColumn(out, vectorise(text))


def embed_queries(queries: DataFrame, make_embedder: Callable[[], Embedder], **how) -> DataFrame:
    return embed(queries, "query_text", make_embedder, out="query_embedding", input_type="search_query", **how)


def embed_documents(chunks: DataFrame, make_embedder: Callable[[], Embedder], **how) -> DataFrame:
    return embed(chunks, "text", make_embedder, out="embedding", input_type="search_document", **how)
