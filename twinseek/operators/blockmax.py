"""Ranked keyword top-k over block-max postings: blocks that cannot reach the k best are not read.

The postings of a word and tenant stand in order of weight (how often the chunk has the word, most first) and id, cut into blocks. A
block's head holds its number of postings, its greatest weight and its first id; ids and positions lie in other columns, which
are read for chosen blocks only.

A chunk that satisfies a group of words has at most (weight of any required word) x (sum of the widths of the group's items) minimal
intervals: at one place of the word no two intervals begin at the same item, but for spans of a phrase that reach over the place,
of which there are fewer than its width. An interval counts for 0.1 at most, so a block's greatest weight bounds the relevance of its
chunks; other groups of the query add the bound of their best block. A search reads the best blocks of each query, and then of the
others only those whose bound reaches the k-th relevance found.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from twinseek.functions import fulltext
from twinseek.operators.candidates import candidates, plain
from twinseek.operators.keyword import PUSHED_WORDS, anchors, chunk_postings, compile_queries, postings
from twinseek.operators.ranking import top_k_per_query
from twinseek.operators.sizing import fits_broadcast
from twinseek.operators.thinning import thinned
from twinseek.session import cut_lineage

# Postings of a block; blocks that a query looks at first, and postings after which it takes no more of them (k if that is more).
BLOCK, FIRST_BLOCKS, FIRST_POSTINGS = 256, 64, 1024
# Postings that are sorted together before they are cut: rows and bytes.
SORTED_ROWS, SORTED_BYTES = 1 << 18, 64 << 20


def block_postings(index: DataFrame, keep: Sequence[str] = (), size: int = BLOCK) -> DataFrame:
    """`lexeme, user_id, n, top, first_id, ids, *keep, positions`: one row per block (`keep`: non-null integer columns).

    Range clustering spreads a word that occurs everywhere over tasks; a block never spans two of them.
    """
    lines = postings(index, keep).unionByName(chunk_postings(index, keep))
    order = ["lexeme", "user_id", F.size("positions").desc(), "id"]
    return blocks_of(lines.repartitionByRange(*order), keep, size)


def blocks_of(lines: DataFrame, keep: Sequence[str] = (), size: int = BLOCK) -> DataFrame:
    """The same of postings that are clustered already: no shuffle. A word that spans tasks, or runs of postings sorted together, has
    blocks of its own in each."""
    schema = ", ".join(
        ["lexeme string, user_id long, n int, top int, first_id long, ids array<long>", *[f"{c} array<long>" for c in keep]]
    )
    clustered = lines.select(
        "lexeme", F.col("user_id").cast("long").alias("user_id"), F.col("id").cast("long").alias("id"),
        *[F.col(c).cast("long").alias(c) for c in keep], "positions", F.size("positions").alias("weight"),
    )
    return clustered.mapInArrow(_cut(size, list(keep)), f"{schema}, positions array<array<int>>")


def _cut(size: int, keep: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        lexemes = rows["lexeme"].combine_chunks().dictionary_encode()
        rank = np.empty(len(lexemes.dictionary), np.int64)
        rank[pc.array_sort_indices(lexemes.dictionary).to_numpy()] = np.arange(len(rank))
        words = rank[lexemes.indices.to_numpy()]
        users = rows["user_id"].fill_null(-1).to_numpy()
        weights, ids = rows["weight"].to_numpy(), rows["id"].to_numpy()
        order = np.lexsort((ids, -weights.astype(np.int64), users, words))
        words, users = words[order], users[order]
        batch = rows.take(pa.array(order)).combine_chunks()
        first = np.flatnonzero(np.r_[True, (words[1:] != words[:-1]) | (users[1:] != users[:-1])])
        place = np.arange(len(words))
        place -= np.repeat(first, np.diff(np.r_[first, len(words)]))
        starts = np.flatnonzero(place % size == 0)
        offsets = pa.array(np.r_[starts, len(words)].astype(np.int32))
        at = pa.array(starts)
        lists = [pa.ListArray.from_arrays(offsets, plain(batch[c])) for c in ["id", *keep, "positions"]]
        return pa.RecordBatch.from_arrays(
            [
                plain(batch["lexeme"].take(at)), plain(batch["user_id"].take(at)), pa.array(np.diff(offsets).astype(np.int32)),
                plain(batch["weight"].take(at)), plain(batch["id"].take(at)), *lists,
            ],
            ["lexeme", "user_id", "n", "top", "first_id", "ids", *keep, "positions"],
        )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.num_rows for b in held) >= SORTED_ROWS or sum(b.nbytes for b in held) >= SORTED_BYTES:
                yield run(pa.Table.from_batches(held))
                held = []
        if held:
            yield run(pa.Table.from_batches(held))

    return cut


def _interval_bound(group: Column) -> Column:
    """Minimal intervals per occurrence of a required word, times what one counts for at most."""
    widths = F.transform(group["must"], lambda item: F.element_at(item, -1)["off"] - F.element_at(item, 1)["off"] + 1)
    return F.aggregate(widths, F.lit(0), lambda total, w: total + w) * F.lit(fulltext.WORD_WEIGHT)


def block_leads(
    queries: DataFrame, blocks: DataFrame, dictionary: str, scoped: bool, known: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """The queries' groups with their anchors, and the head of every block that a group may find its chunks in, with `bound`."""
    columns = ["query_id", "query_text", *(["user_id"] if scoped else [])]
    leads = cut_lineage(anchors(compile_queries(queries.select(*columns), dictionary), known))
    asked = leads.select(
        "query_id", "group_no", F.col("anchor").alias("lexeme"), *(["user_id"] if scoped else []),
        _interval_bound(F.element_at("query", F.col("group_no"))).alias("each"),
    )
    heads = _of_words(blocks, leads.select(F.col("anchor").alias("w"))).select("lexeme", "user_id", "n", "top", "first_id")
    side = F.broadcast(asked) if fits_broadcast(asked) else asked
    met = heads.join(side, ["lexeme", *(["user_id"] if scoped else [])]).withColumn("own", F.col("top") * F.col("each"))
    # chunks of a group may satisfy the query's other groups as well
    best = met.groupBy("query_id", "group_no").agg(F.max("own").alias("best"))
    others = best.groupBy("query_id").agg(F.sum("best").alias("all_groups"))
    reach = best.join(others, "query_id").select("query_id", "group_no", (F.col("all_groups") - F.col("best")).alias("others"))
    bound = F.round(F.col("own") + F.col("others"), fulltext.SCORE_DECIMALS).alias("bound")
    return leads, met.join(reach, ["query_id", "group_no"]).select(
        "query_id", "group_no", "lexeme", "user_id", "first_id", "n", bound
    )


def _of_words(blocks: DataFrame, words: DataFrame) -> DataFrame:
    """Blocks of some words; few words are pushed into the scan, more meet the blocks in a join."""
    distinct = words.distinct()
    used = distinct.limit(PUSHED_WORDS + 1).toArrow()["w"].to_pylist()
    if len(used) <= PUSHED_WORDS:
        return blocks.filter(F.col("lexeme").isin(used))
    side = F.broadcast(distinct) if fits_broadcast(distinct) else distinct
    return blocks.join(side, blocks["lexeme"] == F.col("w"), "left_semi")


def _scored(
    chosen: DataFrame, leads: DataFrame, blocks: DataFrame, lines: DataFrame, k: int, scoped: bool, keep: Sequence[str]
) -> DataFrame:
    """The best matches among the chunks of some blocks: `query_id, id, *keep, relevance`, k of a query at least where there are as many.

    Words of a chunk are put together once, whatever the number of queries that chose it, and matched and ranked inside the tasks. A
    query may thus find chunks of blocks that another one chose.
    """
    key = ["lexeme", "user_id", "first_id"]
    own = ["id", "user_id", *keep]
    picked = cut_lineage(chosen.select(*key).distinct())
    read = thinned(blocks.drop("n", "top"), picked, key).join(picked, key, "left_semi")
    zipped = F.arrays_zip(F.col("ids").alias("id"), *keep, "positions")
    found = read.select("lexeme", "user_id", F.explode(zipped).alias("x")).select(
        "lexeme", "user_id", F.col("x.id").alias("id"), *[F.col(f"x.{c}").alias(c) for c in keep], F.col("x.positions").alias("positions")
    )
    found = cut_lineage(found)
    # words that are looked up; what only leads to chunks, as that of a one-word query, is known from the blocks
    more = leads.select(F.explode("lexemes").alias("lexeme"), "anchor").filter("lexeme <> anchor").select("lexeme").distinct()
    more = cut_lineage(more)
    side = F.broadcast(more) if fits_broadcast(more) else more
    looked_up = thinned(lines.select("lexeme", *own, "positions").join(side, "lexeme", "left_semi"), found, ["id"])
    anchored = found.join(side, "lexeme", "left_anti")
    # every chunk of a block counts, as often as the block has it, and so does a word of the chunk
    both = anchored.select("lexeme", *own, "positions").unionByName(
        looked_up.withColumn("user_id", F.col("user_id").cast("long")).withColumns({c: F.col(c).cast("long") for c in ["id", *keep]})
    )
    entry = F.when(F.col("lexeme") != fulltext.EVERY_CHUNK, F.struct("lexeme", "positions"))
    times = F.count_if(F.col("lexeme") == fulltext.EVERY_CHUNK)
    rows = both.groupBy(*own).agg(F.collect_list(entry).alias("text_search_vector"), times.alias("times"))
    rows = rows.withColumn("time", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.col("times"))))).drop("time", "times")
    asking = leads.join(chosen.select("query_id", "group_no").distinct(), ["query_id", "group_no"], "left_semi")
    ranked = candidates(cut_lineage(asking), rows, scoped, None, keep, k)
    ranked = ranked.join(leads.select("lead", "query_id"), "lead")
    return ranked.select("query_id", "id", *keep, F.round("raw", fulltext.SCORE_DECIMALS).alias("relevance"))


def block_topk(
    queries: DataFrame,
    blocks: DataFrame,
    lines: DataFrame,
    k: int,
    dictionary: str = "english",
    scoped: bool = True,
    known: DataFrame | None = None,
    keep: Sequence[str] = (),
) -> tuple[DataFrame, DataFrame]:
    """Best k matches per query (`query_id, id, *keep, relevance, rank`), and what was read: `query_id, postings, postings_read`.

    `blocks` are stored block postings, `lines` the stored postings that the other words of a query are looked up in. A text that many
    queries of a tenant ask is looked for once. Both parts of the result hang on tables written for this search.
    """
    by = ["query_text", *(["user_id"] if scoped else [])]
    own = queries.select("query_id", *by)
    texts = cut_lineage(own.select(*by).distinct().withColumn("query_id", F.monotonically_increasing_id()))
    best, report = _text_topk(texts, blocks, lines, k, dictionary, scoped, known, keep)
    asking = own.join(texts.select(*by, F.col("query_id").alias("text_no")), by).select("query_id", "text_no")
    best = best.withColumnRenamed("query_id", "text_no").join(asking, "text_no").select("query_id", "id", *keep, "relevance")
    read = report.withColumnRenamed("query_id", "text_no").join(asking, "text_no")
    read = read.groupBy("query_id").agg(F.sum("postings").alias("postings"), F.sum("postings_read").alias("postings_read"))
    return top_k_per_query(best, "relevance", k, descending=True), read


def _text_topk(
    texts: DataFrame,
    blocks: DataFrame,
    lines: DataFrame,
    k: int,
    dictionary: str,
    scoped: bool,
    known: DataFrame | None,
    keep: Sequence[str],
) -> tuple[DataFrame, DataFrame]:
    """The same for distinct texts, of numbers `query_id`."""
    leads, heads = block_leads(texts, blocks, dictionary, scoped, known)
    heads = cut_lineage(heads)
    leads = cut_lineage(leads.withColumn("lead", F.monotonically_increasing_id()))
    order = Window.partitionBy("query_id").orderBy(F.col("bound").desc(), "first_id", "lexeme", "user_id", "group_no")
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # fewer postings than k could not bound anything
    first = heads.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= max(FIRST_BLOCKS, k))
    first = cut_lineage(first.withColumn("before", before).filter(F.col("before") < max(FIRST_POSTINGS, k)).drop("place", "before"))
    found = cut_lineage(top_k_per_query(_scored(first, leads, blocks, lines, k, scoped, keep), "relevance", k, descending=True))
    kth = found.filter(F.col("rank") == k).select("query_id", F.col("relevance").alias("kth"), F.col("id").alias("kth_id"))
    key = ["query_id", "group_no", "lexeme", "user_id", "first_id"]
    left = heads.join(first.select(*key), key, "left_anti").join(kth, "query_id", "left")
    # a block of equal bound can still win by id
    may_win = F.col("kth").isNull() | (F.col("bound") > F.col("kth"))
    may_win = may_win | ((F.col("bound") == F.col("kth")) & (F.col("first_id") < F.col("kth_id")))
    second = cut_lineage(left.filter(may_win).drop("kth", "kth_id"))
    # what was found before is not counted again; what was found and is not among the k best cannot become one of them
    rest = _scored(second, leads, blocks, lines, k, scoped, keep).join(found.select("query_id", "id").distinct(), ["query_id", "id"], "left_anti")
    best = top_k_per_query(found.drop("rank").unionByName(rest), "relevance", k, descending=True)
    read = first.select("query_id", "n").unionByName(second.select("query_id", "n")).groupBy("query_id")
    total = heads.groupBy("query_id").agg(F.sum("n").alias("postings"))
    report = total.join(read.agg(F.sum("n").alias("postings_read")), "query_id")
    return best.drop("rank"), report
