"""Candidates of keyword queries: the chunks that hold all words a query group requires, found batch by batch where the chunks lie.

Words of the groups and of an Arrow batch of text vectors are numbered; a group starts from the chunks that hold the rarest of its
required words in the batch and keeps those that hold each other one, for all groups at once. Only what is left leaves the task, with
the query's words of the chunk. Phrases, exclusions and relevance are worked out of those afterwards (`keyword.matched`).

Where the best k matches of a group are wanted, they are ranked where they are found, and a task hands on k of them (`ranked`).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from twinseek.functions.fulltext import EVERY_CHUNK, VECTOR_TYPE, group_words
from twinseek.session import cut_lineage

# Bound on the groups that travel to the tasks, and on a block of more of them: rows, and bytes of their words.
ASKED_ROWS, ASKED_BYTES = 200_000, 64 << 20
# Chunks of a shard that meet a block of groups; rows and bytes that are looked at together, and pairs that are checked at once.
SHARD_ROWS = 1 << 18
BATCH_ROWS, BATCH_BYTES = 1 << 16, 32 << 20
PAIRS = 1 << 20


def places(offsets: np.ndarray) -> np.ndarray:
    """Number of each item inside its list, for lists that end at `offsets[1:]`."""
    return np.arange(offsets[-1]) - np.repeat(offsets[:-1], np.diff(offsets))


def plain(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


class Asked:
    """Query groups (`lead, scope, words, lexemes`), ready to meet batches of chunks."""

    def __init__(self, leads: pa.Table):
        self.leads = leads["lead"].to_numpy()
        lists = [plain(leads[c]) for c in ("words", "lexemes")]
        lengths = [np.asarray(x.value_lengths(), dtype=np.int64) for x in lists]
        flat = [x.flatten() for x in lists]
        self.words = pa.concat_arrays(flat).unique()
        self.scopes = plain(leads["scope"]).unique()
        scope = pc.index_in(plain(leads["scope"]), value_set=self.scopes).to_numpy().astype(np.int64)
        keys = [
            np.repeat(scope, n) * max(len(self.words), 1) + pc.index_in(x, value_set=self.words).to_numpy().astype(np.int64)
            for x, n in zip(flat, lengths, strict=True)
        ]
        self.keys, at = np.unique(np.concatenate(keys), return_inverse=True)
        self.required, self.mentioned = at[: len(keys[0])], at[len(keys[0]) :]
        self.first, self.start = (np.r_[0, np.cumsum(n)] for n in lengths)
        self.every = pc.index_in(pa.array([EVERY_CHUNK]), value_set=self.words)[0].as_py()

    def meet(self, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        """Candidates among some chunks: the group's number, the chunk's columns, and its words that the query mentions."""
        entries = plain(rows["text_search_vector"]).flatten()
        for lead, row in self.pairs(rows, entries):
            yield self._handed_on(lead, row, entries, rows)

    def pairs(self, rows: pa.Table, entries: pa.StructArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of group and chunk that holds its required words, a bounded number at once."""
        lengths = np.asarray(plain(rows["text_search_vector"]).value_lengths().fill_null(0), dtype=np.int64)
        scope = pc.index_in(plain(rows["scope"]), value_set=self.scopes).fill_null(-1).to_numpy().astype(np.int64)
        word = pc.index_in(entries.field("lexeme"), value_set=self.words).fill_null(-1).to_numpy().astype(np.int64)
        row, entry = np.repeat(np.arange(len(lengths)), lengths), np.arange(len(word))
        if self.every is not None:
            word, row = np.r_[word, np.full(len(lengths), self.every)], np.r_[row, np.arange(len(lengths))]
            entry = np.r_[entry, np.full(len(lengths), -1)]
        held = (word >= 0) & (scope[row] >= 0)
        word, row, entry = word[held], row[held], entry[held]
        key = scope[row] * max(len(self.words), 1) + word
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        held = self.keys[at] == key
        at, row, entry = at[held], row[held], entry[held]
        order = np.lexsort((row, at))
        at, self.row, self.entry = at[order], row[order], entry[order]
        self.width = max(len(lengths), 1)
        self.lines = at * self.width + self.row
        counts = np.bincount(at, minlength=len(self.keys))
        self.begin = np.cumsum(counts) - counts
        alive = np.flatnonzero(np.minimum.reduceat(counts[self.required], self.first[:-1]) > 0)
        # the required words of a group, those first that the fewest of these chunks hold
        n = np.diff(self.first)[alive]
        group = np.repeat(np.arange(len(alive)), n)
        words = self.required[self.first[alive[group]] + places(np.r_[0, np.cumsum(n)])]
        words = words[np.lexsort((counts[words], group))]
        head = np.cumsum(n) - n
        # as many groups at once as start from a bounded number of pairs
        started = counts[words[head]]
        for part in np.split(np.arange(len(alive)), np.flatnonzero(np.diff(np.cumsum(started) // PAIRS)) + 1):
            if len(part):
                at, found = self._holding(words, head[part], n[part], started[part])
                if len(at):
                    yield alive[part[at]], found

    def find(self, at: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Line of a word in a chunk, -1 where it does not occur."""
        wanted = at * self.width + row
        line = np.minimum(np.searchsorted(self.lines, wanted), len(self.lines) - 1)
        return np.where(self.lines[line] == wanted, line, -1)

    def _holding(self, words: np.ndarray, head: np.ndarray, n: np.ndarray, started: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of group and chunk that holds its `n` words from place `head` on, of which the first leads to `started` chunks."""
        offsets = np.r_[0, np.cumsum(started)]
        at = np.repeat(np.arange(len(head)), started)
        row = self.row[np.repeat(self.begin[words[head]], started) + places(offsets)]
        for j in range(1, int(n.max())):
            more = n[at] > j
            keep = ~more
            keep[more] = self.find(words[head[at[more]] + j], row[more]) >= 0
            at, row = at[keep], row[keep]
        return at, row

    def _lines_of(self, lead: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The words of each pair's query that its chunk holds: number of the pair, place of the word in the query, line."""
        n = (self.start[lead + 1] - self.start[lead]).astype(np.int64)
        slot = places(np.r_[0, np.cumsum(n)])
        pair = np.repeat(np.arange(len(lead)), n)
        line = self.find(self.mentioned[self.start[lead[pair]] + slot], row[pair])
        held = line >= 0
        return pair[held], slot[held], line[held]

    def _handed_on(self, lead: np.ndarray, row: np.ndarray, entries: pa.StructArray, rows: pa.Table) -> pa.RecordBatch:
        pair, _, line = self._lines_of(lead, row)
        offsets = np.r_[0, np.cumsum(np.bincount(pair, minlength=len(lead)))].astype(np.int32)
        words = pa.ListArray.from_arrays(pa.array(offsets), entries.take(pa.array(self.entry[line])))
        carried = [c for c in rows.column_names if c not in ("scope", "alike", "text_search_vector")]
        at = pa.array(row)
        columns = [pa.array(self.leads[lead], pa.int64()), *[plain(rows[c]).take(at) for c in carried], words]
        return pa.RecordBatch.from_arrays(columns, ["lead", *carried, "text_search_vector"])


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches joined up to a bounded size."""
    kept: list[pa.RecordBatch] = []
    n = size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        kept.append(batch)
        n, size = n + batch.num_rows, size + batch.nbytes
        if n >= BATCH_ROWS or size >= BATCH_BYTES:
            yield pa.Table.from_batches(kept)
            kept, n, size = [], 0, 0
    if kept:
        yield pa.Table.from_batches(kept)


def _scope(scoped: bool) -> Column:
    return F.col("user_id").cast("string") if scoped else F.lit("")


def candidates(
    leads: DataFrame,
    index: DataFrame,
    scoped: bool,
    small: bool | None = None,
    keep: Sequence[str] = (),
    best: int | None = None,
    alike: Column | None = None,
) -> DataFrame:
    """Chunks that hold all required words of a group: `lead, id, *keep, text_search_vector` (the query's words of the chunk).

    `leads` is a stored table with a number `lead` in each row. Groups of bounded, measured size travel to the chunks, which are read
    where they lie and not shuffled; `small` false, or more groups, meet the chunks by shuffle, in blocks of groups and shards of chunks.
    With `best` the matches among them: `lead, id, *keep, alike, raw` (the relevance before it is rounded). A group need not return
    those that `best` others of the same `alike` value are at least as good as.
    """
    words = F.array_distinct(F.concat(F.array("anchor"), group_words(F.element_at("query", F.col("group_no")))))
    more = [F.col("lexemes")] if best is None else ranked.item_columns()
    asked = leads.select("lead", _scope(scoped).alias("scope"), words.alias("words"), *more).filter(F.col("scope").isNotNull())
    rows = index.select(
        "id", *keep, _scope(scoped).alias("scope"), (F.lit("") if alike is None else alike.cast("string")).alias("alike"),
        F.col("text_search_vector").cast(VECTOR_TYPE).alias("text_search_vector"),
    ).filter(F.col("scope").isNotNull())
    carried = [rows.schema[c] for c in ["id", *keep, *(["text_search_vector"] if best is None else ["alike"])]]
    schema = StructType([StructField("lead", LongType()), *[StructField(f.name, f.dataType) for f in carried]])
    if best is not None:
        schema = schema.add("raw", DoubleType())
    held = F.octet_length(F.concat_ws(" ", "words")) + F.octet_length(F.concat_ws(" ", "lexemes"))
    size = asked.agg(F.count("*").alias("rows"), F.coalesce(F.sum(held), F.lit(0)).alias("bytes")).first()
    if not size["rows"]:
        return leads.sparkSession.createDataFrame([], schema)
    blocks = max(-(-size["rows"] // ASKED_ROWS), -(-size["bytes"] // ASKED_BYTES))
    if blocks == 1 and small is not False:
        return rows.mapInArrow(_scan(asked.toArrow(), best), schema)
    shards = max(1, -(-index.count() // SHARD_ROWS))
    block = F.pmod(F.xxhash64("lead"), F.lit(blocks)).cast("int").alias("block")
    shard = F.pmod(F.xxhash64("id", F.lit("shard")), F.lit(shards)).cast("int").alias("shard")
    left = cut_lineage(asked).select("*", block, F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    right = rows.select("*", shard, F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    keys = ["block", "shard"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_meeting(best, schema), schema)


def _found(leads: pa.Table, best: int | None, rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    if best is not None:
        yield from ranked.Ranked(leads, best).best_of(_together(rows))
        return
    asked = Asked(leads)
    for part in _together(rows):
        yield from asked.meet(part)


def _scan(leads: pa.Table, best: int | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _found(leads, best, batches)

    return scan


def _meeting(best: int | None, schema: StructType) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    nothing = to_arrow_schema(schema).empty_table()

    def meet(key: tuple, leads: pa.Table, rows: pa.Table) -> pa.Table:
        if not leads.num_rows or not rows.num_rows:
            return nothing
        rows = rows.drop_columns(["block", "shard"])
        found = list(_found(leads, best, iter(rows.to_batches(BATCH_ROWS))))
        if not found:
            return nothing
        # rows of one id met each other in the join of this form, and still count so
        copies = rows.group_by("id").aggregate([([], "count_all")])
        pairs = pa.Table.from_batches(found).cast(nothing.schema)
        if copies.num_rows == rows.num_rows:
            return pairs
        n = copies["count_all"].take(pc.index_in(pairs["id"], value_set=plain(copies["id"]))).to_numpy()
        return pairs.take(pa.array(np.repeat(np.arange(len(n)), n)))

    return meet


# it builds on the classes above
from twinseek.operators import ranked  # noqa: E402
