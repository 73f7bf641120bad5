"""Keyword search over text vectors: matching, cover-density rank, top-k, for batches of queries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinseek.functions import fulltext
from twinseek.operators.candidates import candidates
from twinseek.operators.ranking import top_k_per_query
from twinseek.operators.sizing import fits_broadcast
from twinseek.operators.thinning import thinned
from twinseek.session import cut_lineage

# Words of a batch up to this many are pushed into the postings scan.
PUSHED_WORDS = 2_000


def text_index(chunks: DataFrame, dictionary: str = "english", keep: Sequence[str] = ()) -> DataFrame:
    """`id, user_id, ..., text_search_vector`: one row per chunk with text. No shuffle."""
    return chunks.filter(F.col("text").isNotNull()).select(
        "id", "user_id", *keep, fulltext.text_vector(F.col("text"), dictionary).alias("text_search_vector")
    )


def postings(index: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """`lexeme, id, user_id, *keep, positions`: the index turned to one row per word and chunk."""
    return index.select("id", "user_id", *keep, F.explode("text_search_vector").alias("entry")).select(
        F.col("entry.lexeme").alias("lexeme"), "id", "user_id", *keep, F.col("entry.positions").alias("positions")
    )


def chunk_postings(index: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """One more row per chunk under the word that stands for every chunk; stored with the postings."""
    return index.select(
        F.lit(fulltext.EVERY_CHUNK).alias("lexeme"), "id", "user_id", *keep, F.array().cast("array<int>").alias("positions")
    )


def vocabulary(index: DataFrame) -> DataFrame:
    """`lexeme, n_chunks`: how many chunks hold each lexeme (partial counts before the shuffle)."""
    return (
        index.select(F.explode("text_search_vector.lexeme").alias("lexeme"))
        .groupBy("lexeme")
        .agg(F.count("*").alias("n_chunks"))
    )


def postings_vocabulary(lines: DataFrame) -> DataFrame:
    """The same of postings clustered by lexeme: hardly more than one partial count of a word is shuffled."""
    words = lines.filter(F.col("lexeme") != fulltext.EVERY_CHUNK)
    return words.groupBy("lexeme").agg(F.count("*").alias("n_chunks"))


def compile_queries(queries: DataFrame, dictionary: str = "english") -> DataFrame:
    """Adds the compiled form, all its words and the required ones. A query that can match nothing has no groups."""
    return queries.withColumn("query", fulltext.query_column(dictionary)).withColumns(
        {"lexemes": fulltext.query_lexemes(F.col("query")), "required": fulltext.required_words(F.col("query"))}
    )


def anchors(compiled: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """One row per query and group with the lexeme that leads to its candidates.

    Any required word would do. With a vocabulary the rarest is taken, otherwise the longest. A group without required
    words is anchored at every chunk.
    """
    # the outer form keeps Catalyst from compiling the query a second time for a size filter
    groups = compiled.select("*", F.posexplode_outer("query").alias("g", "group")).filter(F.col("group").isNotNull())
    words = fulltext.group_words(F.col("group"))
    if known is None:
        longest = F.array_sort(F.transform(words, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w"))))
        lexeme = F.coalesce(F.try_element_at(longest, F.lit(1))["w"], F.lit(fulltext.EVERY_CHUNK))
        return groups.select(*compiled.columns, (F.col("g") + 1).alias("group_no"), lexeme.alias("anchor"))
    rarest = (
        groups.select("query_id", "g", F.explode(words).alias("lexeme"))
        .join(known, "lexeme", "left")
        .groupBy("query_id", "g")
        .agg(F.min_by("lexeme", F.struct(F.coalesce("n_chunks", F.lit(0)), "lexeme")).alias("word"))
    )
    return groups.join(rarest, ["query_id", "g"], "left").select(
        *compiled.columns,
        (F.col("g") + 1).alias("group_no"),
        F.coalesce("word", F.lit(fulltext.EVERY_CHUNK)).alias("anchor"),
    )


def keyword_matches(
    queries: DataFrame,
    index: DataFrame,
    dictionary: str = "english",
    scoped: bool = True,
    known: DataFrame | None = None,
    small: bool | None = None,
    keep: Sequence[str] = (),
    lines: DataFrame | None = None,
    best: int | None = None,
    alike: Column | None = None,
) -> DataFrame:
    """Every matching chunk of every query: `query_id, id, *keep, relevance` (`keep`: columns of the index).

    `queries` has `query_id, query_text` and, when scoped, `user_id`. Only chunks that hold a group's anchor word are
    looked at; the rest of the query is checked inside the chunk row, so words are never joined to words.

    The words of all queries meet the text vectors in batches (`candidates`), which drops chunks that lack a required word before
    anything is matched or shuffled:

    - A batch of measured size travels to the index, which is read in place.
    - A larger one, or one said not to be `small`, meets the index by shuffle.
    - With stored postings (`lines`, clustered by lexeme) the text vectors are put together from the words asked for.

    With `best` only matches that may be among the best so many of a query, and of chunks alike in `alike`, need be returned: they are
    ranked inside the tasks that read the chunks, and a text that many queries of a tenant ask is looked for once.
    """
    own = _query_columns(queries, scoped)
    if best is not None:
        return _best_matches(own, index, dictionary, scoped, known, small, keep, lines, best, alike)
    compiled = anchors(compile_queries(own, dictionary), known)
    leads = cut_lineage(compiled.withColumn("lead", F.monotonically_increasing_id()))
    rows = index if lines is None else _from_postings(leads, lines, scoped, keep)
    found = candidates(leads, rows, scoped, small, keep)
    asking = leads.select("lead", "query_id", "group_no", "query", "lexemes", "required")
    side = F.broadcast(asking) if small is not False and fits_broadcast(asking) else asking
    return matched(found.join(side, "lead"), keep)


def _best_matches(
    own: DataFrame,
    index: DataFrame,
    dictionary: str,
    scoped: bool,
    known: DataFrame | None,
    small: bool | None,
    keep: Sequence[str],
    lines: DataFrame | None,
    best: int,
    alike: Column | None,
) -> DataFrame:
    by = [c for c in own.columns if c != "query_id"]
    # compiling is the work of the few rows, so they are spread whatever their size
    spread = own.select(*by).repartition(own.sparkSession.sparkContext.defaultParallelism, *by)
    texts = cut_lineage(spread.distinct().withColumn("query_id", F.monotonically_increasing_id()))
    compiled = anchors(compile_queries(texts, dictionary), known)
    leads = cut_lineage(compiled.withColumn("lead", F.monotonically_increasing_id()))
    rows = index if lines is None else _from_postings(leads, lines, scoped, keep)
    found = candidates(leads, rows, scoped, small, keep, best, alike)
    # leads and texts are small tables next to what is found
    found = found.join(leads.select("lead", F.col("query_id").alias("text_no")), "lead")
    found = found.select("text_no", "id", *keep, "alike", F.round("raw", fulltext.SCORE_DECIMALS).alias("relevance"))
    few = top_k_per_query(found, "relevance", best, by=["text_no", "alike"], descending=True).drop("rank", "alike")
    asking = own.join(texts.select(*by, F.col("query_id").alias("text_no")), by).select("query_id", "text_no")
    return few.join(asking, "text_no").select("query_id", "id", *keep, "relevance")


def matched(pairs: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Candidate pairs that match, with their relevance; `text_search_vector` has the words of the query at least."""
    # a chunk may be reached through several groups; the first satisfied one reports it. The generator evaluates the match
    # once, where a filter and a projection would each do it
    hits = F.filter(F.array(fulltext.groups_column()), lambda g: fulltext.first_match(g) == F.col("group_no"))
    return (
        pairs.select("query_id", "id", *keep, "text_search_vector", "required", F.explode_outer(hits).alias("groups"))
        .filter(F.col("groups").isNotNull())
        .select("query_id", "id", *keep, fulltext.relevance_column().alias("relevance"))
    )


def _from_postings(leads: DataFrame, lines: DataFrame, scoped: bool, keep: Sequence[str]) -> DataFrame:
    """Text vectors of the words that queries mention, from postings alone.

    Few words are pushed into the scan, so the postings of others are skipped by their row-group bounds; more meet the postings in a
    join. One shuffle of those postings, however many queries share a word, and of hardly any chunk without an anchor: no group can
    find it.
    """
    used = leads.select(F.explode(F.array_union("lexemes", F.array("anchor"))).alias("lexeme")).distinct()
    few = used.limit(PUSHED_WORDS + 1).toArrow()["lexeme"].to_pylist()
    if len(few) <= PUSHED_WORDS:
        wanted = lines.filter(F.col("lexeme").isin(few))
    else:
        wanted = lines.join(F.broadcast(used) if fits_broadcast(used) else used, "lexeme", "left_semi")
    asked = leads.select(F.col("anchor").alias("lexeme"), *(["user_id"] if scoped else [])).distinct()
    side = F.broadcast(asked) if fits_broadcast(asked) else asked
    anchored = lines.join(side, ["lexeme", *(["user_id"] if scoped else [])], "left_semi").select("id")
    wanted = thinned(wanted, anchored, ["id"])
    # the line that stands for every chunk adds no word to it
    entry = F.when(F.col("lexeme") != fulltext.EVERY_CHUNK, F.struct("lexeme", "positions"))
    by = dict.fromkeys(["id", *(["user_id"] if scoped else []), *keep])
    return wanted.groupBy(*by).agg(F.collect_list(entry).alias("text_search_vector"))


def keyword_topk(queries: DataFrame, index: DataFrame, k: int, **how) -> DataFrame:
    """Best k matches per query: `query_id, id, relevance, rank`."""
    return top_k_per_query(keyword_matches(queries, index, best=k, **how), "relevance", k, descending=True)


def _query_columns(queries: DataFrame, scoped: bool) -> DataFrame:
    return queries.select("query_id", "query_text", *(["user_id"] if scoped else []))
