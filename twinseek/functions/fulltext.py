"""Full-text expressions: text vectors, compiled queries, matching and cover-density rank.

A text vector is the sorted array of `{lexeme, positions}` of one text. A compiled query is an OR of groups; a group holds
the items that must occur and the items that must not; an item is a list of `{lex, off}`, one word or a phrase whose words
stand at the given distances. Matching and ranking read one chunk row and one query row and nothing else, so they run
wherever the chunk row already is.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

from twinseek.functions.stemming import normalise_english

DICTIONARIES = ("simple", "english")
TOKEN_PATTERN = r"[\p{L}\p{N}]+"
# a quoted phrase or a bare word, either with a leading minus
ITEM_PATTERN = r'-?"[^"]*"|[^\s"]+'
# Fixed value: weight of one matched word in the cover-density rank.
WORD_WEIGHT = 0.1
SCORE_DECIMALS = 9
REMEMBERED_WORDS = 1 << 18
# Lexeme that stands for "every chunk": anchors query groups made of negations only.
EVERY_CHUNK = ""

VECTOR_TYPE = "array<struct<lexeme:string,positions:array<int>>>"
_ITEM = "array<struct<lex:string,off:int>>"
QUERY_TYPE = f"array<struct<must:array<{_ITEM}>,must_not:array<{_ITEM}>>>"


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once per row and hand it to `use`."""
    return F.element_at(F.transform(F.array(value), use), 1)


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN_PATTERN), F.lit(0))


def _normaliser(dictionary: str) -> Callable[[str], str | None]:
    """Word to lexeme, with a memory that lasts for a task: most words of a batch were seen in the one before."""
    if dictionary not in DICTIONARIES:
        raise ValueError(f"unknown dictionary {dictionary!r}, expected one of {DICTIONARIES}")
    if dictionary == "simple":
        return lambda word: word
    seen: dict[str, str | None] = {}

    def normalise(word: str) -> str | None:
        if word not in seen:
            if len(seen) >= REMEMBERED_WORDS:
                seen.clear()
            seen[word] = normalise_english(word)
        return seen[word]

    return normalise


def _group_positions(token_lists: pa.Array, normalise: Callable[[str], str | None]) -> pa.Array:
    """Sorted `{lexeme, positions}` per list, worked out for a whole Arrow batch with one sort."""
    lengths = np.asarray(token_lists.value_lengths().fill_null(0), dtype=np.int64)
    flat = token_lists.flatten().dictionary_encode()
    words = flat.dictionary.to_pylist()
    lexemes = [normalise(w) for w in words]
    vocabulary = sorted({x for x in lexemes if x is not None})
    code_of = {x: i for i, x in enumerate(vocabulary)}
    recode = np.array([code_of.get(x, -1) for x in lexemes] or [-1], dtype=np.int64)
    codes = recode[np.asarray(flat.indices, dtype=np.int64)]
    rows = np.repeat(np.arange(len(lengths)), lengths)
    starts = np.cumsum(lengths) - lengths
    positions = np.arange(len(codes)) - np.repeat(starts, lengths) + 1

    kept = codes >= 0
    key = rows[kept] * max(len(vocabulary), 1) + codes[kept]
    order = np.argsort(key, kind="stable")
    key, positions = key[order], positions[kept][order].astype(np.int32)
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.array([], dtype=np.int64)
    position_lists = pa.ListArray.from_arrays(
        pa.array(np.r_[first, len(key)].astype(np.int32)), pa.array(positions, pa.int32())
    )
    names = pa.array(vocabulary, pa.string()).take(pa.array(key[first] % max(len(vocabulary), 1)))
    entries = pa.StructArray.from_arrays([names, position_lists], ["lexeme", "positions"])
    per_row = np.bincount(rows[kept][order][first], minlength=len(lengths))
    offsets = np.r_[0, np.cumsum(per_row)].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), entries)


def text_vector(text: Column, dictionary: str = "english") -> Column:
    """Lexemes of a text with their 1-based word positions; dropped stop words still count as positions."""
    normalise = _normaliser(dictionary)

    @F.arrow_udf(VECTOR_TYPE)
    def group_positions(token_lists: pa.Array) -> pa.Array:
        return _group_positions(token_lists, normalise)

    return group_positions(tokens(text))


def lexemes_of(words: Column, dictionary: str) -> Column:
    """Lexeme of every word of an array, null for stop words."""
    if dictionary == "simple":
        return words
    normalise = _normaliser(dictionary)

    @F.arrow_udf("array<string>")
    def lookup(token_lists: pa.Array) -> pa.Array:
        flat = token_lists.flatten().dictionary_encode()
        table = pa.array([normalise(w) for w in flat.dictionary.to_pylist()], pa.string())
        lengths = np.asarray(token_lists.value_lengths().fill_null(0), dtype=np.int64)
        offsets = pa.array(np.r_[0, np.cumsum(lengths)].astype(np.int32))
        return pa.ListArray.from_arrays(offsets, table.take(flat.indices))

    return lookup(words)


def compile_query(text: Column, dictionary: str = "english") -> Column:
    """Words are required, quoted words form a phrase, `or` separates alternatives, a leading minus excludes.

    Blank text and text made of stop words only compile to an empty array, which matches nothing.
    """
    items = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(ITEM_PATTERN), F.lit(0))

    def split_groups(xs: Column) -> Column:
        size = F.size(xs)
        cuts = F.filter(
            F.transform(xs, lambda x, i: F.when(F.lower(x) == "or", i + 1)), lambda i: i.isNotNull()
        )
        edges = F.concat(F.array(F.lit(0)), cuts, F.array(size + 1))
        return F.transform(
            F.sequence(F.lit(1), F.size(edges) - 1),
            lambda g: F.slice(
                xs,
                F.element_at(edges, g) + 1,
                F.element_at(edges, g + 1) - F.element_at(edges, g) - 1,
            ),
        )

    def mapped(table: Column) -> Column:
        def item(x: Column) -> Column:
            words = F.transform(tokens(x), lambda w, i: F.struct(F.try_element_at(table, w).alias("lex"), i.alias("off")))
            return F.filter(words, lambda w: w["lex"].isNotNull())

        def side(group: Column, excluded: bool) -> Column:
            chosen = F.filter(group, lambda x: F.startswith(x, F.lit("-")) == F.lit(excluded))
            return F.array_distinct(F.filter(F.transform(chosen, item), lambda i: F.size(i) > 0))

        groups = F.transform(
            bind(items, split_groups), lambda g: F.struct(side(g, False).alias("must"), side(g, True).alias("must_not"))
        )
        return F.filter(groups, lambda g: (F.size(g["must"]) > 0) | (F.size(g["must_not"]) > 0))

    words = F.array_distinct(F.coalesce(tokens(text), F.array().cast("array<string>")))
    pairs = F.map_from_arrays(words, lexemes_of(words, dictionary))
    return bind(pairs, mapped).cast(QUERY_TYPE)


def query_lexemes(query: Column) -> Column:
    """Every lexeme a compiled query mentions."""
    per_group = F.transform(query, lambda g: F.flatten(F.concat(g["must"], g["must_not"])))
    return F.array_distinct(F.transform(F.flatten(per_group), lambda w: w["lex"]))


def group_words(group: Column) -> Column:
    """Lexemes a group requires; any one of them can anchor the search for candidates."""
    return F.array_distinct(F.transform(F.flatten(group["must"]), lambda w: w["lex"]))


def _positions(table: Column, lexeme: Column) -> Column:
    return F.coalesce(F.try_element_at(table, lexeme), F.array().cast("array<int>"))


def _instances(table: Column, item: Column) -> Column:
    """Places where an item occurs, as `{e, s}`: last and first word position."""
    head = F.element_at(item, 1)
    tail = F.element_at(item, -1)
    width = tail["off"] - head["off"]
    starts = _positions(table, head["lex"])
    whole = F.filter(
        starts,
        lambda p: F.forall(item, lambda w: F.array_contains(_positions(table, w["lex"]), p + w["off"] - head["off"])),
    )
    found = F.when(F.size(item) == 1, starts).otherwise(whole)
    return F.transform(found, lambda p: F.struct((p + width).alias("e"), p.alias("s")))


def match_groups(vector: Column, query: Column, lexemes: Column) -> Column:
    """Per group, what a chunk offers: `{ok, spans}` with one span list per required item.

    `lexemes` is `query_lexemes(query)`, computed once per query.
    """
    entries = F.filter(vector, lambda e: F.array_contains(lexemes, e["lexeme"]))

    def evaluate(table: Column) -> Column:
        def group(g: Column) -> Column:
            return bind(
                F.transform(g["must"], lambda item: _instances(table, item)),
                lambda spans: F.struct(
                    (
                        F.forall(spans, lambda s: F.size(s) > 0)
                        & ~F.exists(g["must_not"], lambda item: F.size(_instances(table, item)) > 0)
                    ).alias("ok"),
                    spans.alias("spans"),
                ),
            )

        return F.transform(query, group)

    return bind(F.map_from_entries(entries), evaluate)


def first_match(groups: Column) -> Column:
    """1-based index of the first satisfied group, 0 when the chunk does not match."""
    return F.array_position(F.transform(groups, lambda g: g["ok"]), True).cast("int")


def required_words(query: Column) -> Column:
    """Distinct lexemes required by any group; compute it once per query, next to `query_lexemes`."""
    return F.array_distinct(F.flatten(F.transform(query, group_words)))


def word_places(vector: Column, required: Column) -> Column:
    """Sorted distinct positions of the required words."""
    mine = F.filter(vector, lambda e: F.array_contains(required, e["lexeme"]))
    return F.array_sort(F.array_distinct(F.flatten(F.transform(mine, lambda e: e["positions"]))))


def cover_density(groups: Column, vector: Column, required: Column) -> Column:
    """Sum over the minimal word intervals that satisfy the query of 0.1 / (1 + words in between).

    Satisfied groups bring their spans ordered by end. Walking over the ends, each item remembers its latest start; the
    interval of a group reaches back to the earliest of those, the interval of the query to the latest over its groups.
    An end counts when its interval starts later than the one before. One-word queries need no walk: every occurrence is
    an interval of its own.
    """
    alive = F.filter(groups, lambda g: g["ok"] & (F.size(g["spans"]) > 0))

    def rank(gs: Column) -> Column:
        occurrences = F.size(F.element_at(F.element_at(gs, 1)["spans"], 1)).cast("double")
        return F.when(F.size(gs) == 0, F.lit(0.0)).otherwise(
            F.when(F.size(required) == 1, occurrences * F.lit(WORD_WEIGHT)).otherwise(
                bind(word_places(vector, required), lambda places: _walk(gs, places))
            )
        )

    # sums that differ only in the last bits are ties
    return F.round(bind(alive, rank), SCORE_DECIMALS)


def _walk(alive: Column, places: Column) -> Column:
    def place(p: Column) -> Column:
        return F.array_position(places, p).cast("int")

    # one event per span: its end, the group and item it belongs to, its start, and both as indexes into `places`
    events = F.array_sort(
        F.flatten(
            F.flatten(
                F.transform(
                    alive,
                    lambda g, gi: F.transform(
                        g["spans"],
                        lambda spans, ii: F.transform(
                            spans,
                            lambda x: F.struct(
                                x["e"].alias("e"),
                                gi.alias("g"),
                                ii.alias("i"),
                                F.struct(x["s"].alias("at"), place(x["s"]).alias("ix")).alias("s"),
                                place(x["e"]).alias("ix"),
                            ),
                        ),
                    ),
                )
            )
        )
    )
    nowhere = F.struct(F.lit(-1).alias("at"), F.lit(0).alias("ix"))
    start = F.struct(
        F.transform(alive, lambda g: F.transform(g["spans"], lambda _: nowhere)).alias("latest"),
        nowhere.alias("b"),
        F.lit(-1).alias("e"),
        F.lit(0).alias("ix"),
        F.lit(0.0).alias("total"),
    )

    def settled(state: Column) -> Column:
        """Total with the pending interval added."""
        noise = (state["e"] - state["b"]["at"]) - (state["ix"] - state["b"]["ix"])
        part = F.lit(WORD_WEIGHT) / (F.lit(1.0) + noise.cast("double"))
        return state["total"] + F.when(state["b"]["at"] > 0, part).otherwise(F.lit(0.0))

    def step(state: Column, event: Column) -> Column:
        latest = F.transform(
            state["latest"],
            lambda items, gi: F.when(
                gi == event["g"],
                F.transform(items, lambda s, ii: F.when(ii == event["i"], F.greatest(s, event["s"])).otherwise(s)),
            ).otherwise(items),
        )

        def advance(new: Column, begin: Column) -> Column:
            better = begin["at"] > state["b"]["at"]
            # the pending interval stands unless another item ends at the same word and shortens it
            stands = better & (state["e"] != event["e"])
            return F.struct(
                new.alias("latest"),
                F.when(better, begin).otherwise(state["b"]).alias("b"),
                F.when(better, event["e"]).otherwise(state["e"]).alias("e"),
                F.when(better, event["ix"]).otherwise(state["ix"]).alias("ix"),
                F.when(stands, settled(state)).otherwise(state["total"]).alias("total"),
            )

        return bind(latest, lambda new: bind(F.array_max(F.transform(new, F.array_min)), lambda b: advance(new, b)))

    return F.aggregate(events, start, step, settled)


# Building these expressions takes a thousand calls to the JVM each, so one copy per application is kept. They name the
# columns of the keyword operators: query_text, query, lexemes, required, groups, text_search_vector.


def _application() -> str:
    return SparkContext._active_spark_context.applicationId


@lru_cache(maxsize=16)
def _kept(application: str, name: str, dictionary: str | None = None) -> Column:
    vector, query = F.col("text_search_vector"), F.col("query")
    if name == "query":
        return compile_query(F.col("query_text"), dictionary)
    if name == "groups":
        return match_groups(vector, query, F.col("lexemes"))
    return cover_density(F.col("groups"), vector, F.col("required"))


def query_column(dictionary: str) -> Column:
    return _kept(_application(), "query", dictionary)


def groups_column() -> Column:
    return _kept(_application(), "groups")


def relevance_column() -> Column:
    return _kept(_application(), "relevance")
