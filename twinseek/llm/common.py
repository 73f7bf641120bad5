"""Shared parts of the training-data operators: reading, stored intermediate tables, words of a text as numbers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinseek.session import shared_folder

# The bytes that separate words (space and the controls 9 to 13).
SPACES = b" \t\n\x0b\x0c\r"
# An Arrow batch holds at most this many bytes, so that a worker's memory does not follow the length of texts.
BATCH_BYTES = 4 << 20


def documents(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """The named columns of the documents table; extra columns of the table never reach an operator."""
    return spark.read.parquet(f"{folder}/documents.parquet").select(*columns)


def bound_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes too, as texts differ a thousandfold in length."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared(spark: SparkSession) -> str:
    """Folder for intermediate tables: the one the cluster names, or a local one where none is set on a local master."""
    folder = shared_folder(spark)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        folder = tempfile.mkdtemp(prefix="twinseek-llm-")
    return folder.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table into the shared folder and read it back: cuts lineage and survives lost executors."""
    path = f"{shared(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def whole_text(column: str = "text") -> Column:
    """The text, empty where null."""
    return F.coalesce(F.col(column), F.lit(""))


def pieces(table: pa.RecordBatch, text: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts hold at most `limit` bytes together; a longer text makes a slice of its own."""
    sizes = pc.fill_null(pc.binary_length(table.column(text)), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if i > start and held + n > limit:
            yield table.slice(start, i - start)
            start, held = i, 0
        held += n
    if len(sizes) > start:
        yield table.slice(start)


def joined_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts of a column as one byte array and the offset of each text in it (one more than texts); null is empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    buffer = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buffer[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_bounds(buffer: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word in joined texts, and how many words each text has."""
    table = np.ones(256, bool)
    table[np.frombuffer(SPACES, np.uint8)] = False
    n = len(buffer)
    inside = table[buffer]
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    edges = offsets[:-1]
    before[edges[edges < n]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    edges = offsets[1:] - 1
    edges = edges[edges >= 0]
    after[edges] = False
    ends = np.flatnonzero(inside & ~after) + 1
    counts = np.diff(np.searchsorted(starts, offsets))
    return starts, ends, counts


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit numbers (the finaliser of a split-mix generator)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _count_words(texts: pa.Array) -> pa.Array:
    out = []
    for part in pieces(pa.record_batch([texts], ["t"]), "t", BATCH_BYTES):
        out.append(word_bounds(*joined_bytes(part.column(0)))[2])
    return pa.array(np.concatenate(out) if out else np.zeros(0, np.int64), pa.int64())


def word_count(text: Column) -> Column:
    """Number of words of a text, 0 where null."""

    def count(texts: pa.Array) -> pa.Array:
        return _count_words(texts)

    return F.arrow_udf(count, "long")(text)
