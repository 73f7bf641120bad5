"""The registered queries: every operator over whole tables."""

from __future__ import annotations

import itertools
import tempfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from twinseek.functions import json as js
from twinseek.functions import text as tx
from twinseek.functions import vectors as vx
from twinseek.functions.fulltext import tokens
from twinseek.operators import ann, blockmax, embed, embed_ledger, enrich, evalset, fusion, heavy, histograms, ingest, jsonindex, keyword, metrics, pq, quality
from twinseek.operators import vector as vec
from twinseek.plans import search, suite
from twinseek.session import cut_lineage, shared_folder
from twinseek.sources import corpus as cp
from twinseek.sources import evalfiles, layout, sampling, timing
from twinseek.streaming import incremental
from twinseek.streaming import ingest as stream

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}

# Parameters of single registered queries.
CHUNK_FILTER = {"position": "beginning", "has_math": False}
DOCUMENT_FILTER = {"language": "en"}
NESTED_FILTERS = {
    "object": {"stats": {"long": True}},
    "array": {"tags": ["src2", "de"]},
    "both": {"lang": "en", "stats": {"long": False}, "tags": ["en"]},
    "element": {"parts": [{"n": 1, "kind": "fr"}]},
    "elements": {"parts": [{"kind": "es"}, {"n": 2}]},
    "anything": {"stats": {}},
    "nothing": {"tags": [["de"]]},
}
# Bytes of vectors of a shard in the registered shuffled searches: a bound passes to other shards on small tables too.
SMALL_SHARD = 1 << 20
# Sizes of result whose readings are compared.
READ_AT = [1, 10, 100]
SHORT_QUERIES = ["the", "of", "and", "de", "la", "the and", "  ", "zzzz"]


def register(function: Query) -> Query:
    REGISTRY[function.__name__] = function
    return function


def r6(name: str) -> Column:
    return F.round(name, 6).alias(name)


_RUNS = itertools.count(1)


def scratch(spark: SparkSession) -> str:
    """A new folder that every executor reaches: inside the cluster's shared folder, or local where none is named."""
    shared = shared_folder(spark)
    if shared is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        return tempfile.mkdtemp(prefix="twinseek-")
    return f"{shared.rstrip('/')}/twinseek-{spark.sparkContext.applicationId}-{next(_RUNS)}"


def known_items(spark: SparkSession, folder: str) -> DataFrame:
    """The known-item queries as a stored table, which is what a batch search gets to read several times."""
    return cut_lineage(cp.known_item_queries(spark, folder))


# ---- ingestion and features


@register
def feature_chunk_stats(spark: SparkSession, folder: str) -> DataFrame:
    return cp.chunks(spark, folder).select("id", "word_count", "char_count", "sentence_count")


@register
def chunk_position_flags(spark: SparkSession, folder: str) -> DataFrame:
    return cp.chunks(spark, folder).select(
        "id", "position", "section_type", "has_code", "has_math", "has_list", "has_table"
    )


@register
def group_documents(spark: SparkSession, folder: str) -> DataFrame:
    return ingest.group_documents(cp.source_items(spark, folder))


@register
def chunk_ordinals(spark: SparkSession, folder: str) -> DataFrame:
    return ingest.chunk_ordinals(cp.source_items(spark, folder)).select("id", "chunk_index", "total_chunks")


@register
def assign_users_even(spark: SparkSession, folder: str) -> DataFrame:
    by_id = ([F.col("wiki_id")], F.floor(F.col("wiki_id") / ingest.ORDINAL_BLOCK))
    return ingest.assign_users(cp.documents(spark, folder).drop("user_id"), cp.users(spark, folder), 30, by_id).select(
        "url", "user_id"
    )


@register
def assign_users_shuffled(spark: SparkSession, folder: str) -> DataFrame:
    dealt = ingest.assign_users(cp.documents(spark, folder).drop("user_id"), cp.users(spark, folder), 30, seed=7)
    return dealt.groupBy("user_id").agg(F.count("*").alias("n_documents"))


@register
def denormalised_chunks(spark: SparkSession, folder: str) -> DataFrame:
    owned = ingest.denormalise(cp.source_items(spark, folder).select("url", "id"), cp.documents(spark, folder).select("url", "id", "user_id"))
    return owned.groupBy("user_id").agg(F.count("*").alias("n_chunks"))


@register
def ingest_stats(spark: SparkSession, folder: str) -> DataFrame:
    return ingest.statistics(cp.users(spark, folder), cp.documents(spark, folder), cp.chunks(spark, folder))


@register
def head_slice(spark: SparkSession, folder: str) -> DataFrame:
    return ingest.head_slice(cp.source_items(spark, folder).select("id", "paragraph_id", "text"), ["id"], 500)


def _letter_embedder():
    """Stands in for a hosted model: length of the text and its number of e's."""
    return lambda texts, input_type: [[len(t), t.count("e")] for t in texts]


@register
def embed_batch(spark: SparkSession, folder: str) -> DataFrame:
    rows = embed.embed_documents(cp.table(spark, folder, "documents").select("doc_id", "text"), _letter_embedder)
    return rows.select(
        "doc_id", F.col("embedding")[0].cast("double").alias("x0"), F.col("embedding")[1].cast("double").alias("x1")
    )


@register
def embed_ledger_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Documents embedded through the ledger: English ones, then all, then all again, which embeds nothing."""
    place = scratch(spark)
    rows = cp.table(spark, folder, "documents").select("doc_id", "lang", "text")
    english = rows.filter(F.col("lang") == "en")
    first = embed_ledger.embed_new(english, "text", _letter_embedder, place, "letters", slice_texts=20_000)
    _, second = embed_ledger.embed_through(rows, "text", _letter_embedder, place, "letters", slice_texts=20_000)
    found, third = embed_ledger.embed_through(rows, "text", _letter_embedder, place, "letters")
    return found.select(
        "doc_id",
        F.col("embedding")[0].cast("double").alias("x0"),
        F.col("embedding")[1].cast("double").alias("x1"),
        F.lit(first + second).cast("long").alias("texts"),
        F.lit(third).cast("long").alias("again"),
    )


@register
def stream_ingest(spark: SparkSession, folder: str) -> DataFrame:
    """Chunk files streamed into the tenant layout, one file twice; then the table."""
    place = scratch(spark)
    arriving = cp.chunks(spark, folder).select(
        "user_document_id", "user_id", "paragraph_id", "chunk_index", "total_chunks", "text", "embedding"
    )
    arriving.write.mode("append").parquet(f"{place}/arriving")
    query = stream.start(spark, f"{place}/arriving", f"{place}/chunks", f"{place}/state", 3, once=True)
    query.awaitTermination()
    # the same rows arrive again and must change nothing
    arriving.write.mode("append").parquet(f"{place}/arriving")
    query = stream.start(spark, f"{place}/arriving", f"{place}/chunks", f"{place}/state", 3, once=True)
    query.awaitTermination()
    meta = F.col("meta")
    return spark.read.parquet(f"{place}/chunks").select(
        "user_document_id",
        "paragraph_id",
        "user_id",
        js.json_text(meta, "word_count").cast("long").alias("word_count"),
        js.json_text(meta, "position").alias("position"),
    )


# ---- data quality


@register
def unique_violations(spark: SparkSession, folder: str) -> DataFrame:
    texts = cp.table(spark, folder, "documents").select(F.md5("text").alias("text_md5"))
    return quality.unique_violations(texts, ["text_md5"])


@register
def unique_chunk_keys(spark: SparkSession, folder: str) -> DataFrame:
    return quality.unique_violations(cp.chunks(spark, folder), ["user_document_id", "paragraph_id"])


@register
def orphan_rows(spark: SparkSession, folder: str) -> DataFrame:
    return quality.orphans(cp.table(spark, folder, "events"), cp.users(spark, folder), "user_id").select("event_id", "user_id")


@register
def vectors_without_text(spark: SparkSession, folder: str) -> DataFrame:
    """The embeddings that searches over embedded chunks leave out, each with its reason."""
    return cp.vectors_without_text(spark, folder).select("vec_id", "label", F.size("embedding").alias("dimensions"), "reason")


@register
def cascade_delete(spark: SparkSession, folder: str) -> DataFrame:
    """Users with fewer English documents than the average go, with everything they own."""
    documents = cp.documents(spark, folder)
    english = documents.groupBy("user_id").agg(F.count_if(F.col("language") == "en").alias("n"))
    average = english.agg(F.avg("n").alias("a"), F.lit(1).alias("one"))
    gone = (
        english.withColumn("one", F.lit(1)).join(average, "one").filter(F.col("n") < F.col("a")).select(F.col("user_id").alias("id"))
    )
    _, _, chunks = quality.cascade_delete(
        cp.users(spark, folder), documents.select("id", "user_id"), cp.chunks(spark, folder).select("id", "user_document_id", "user_id"), gone
    )
    return chunks.select("id", "user_id")


@register
def rule_validation(spark: SparkSession, folder: str) -> DataFrame:
    rules = quality.meta_rules(
        F.col("meta"), {"word_count": (5, None), "sentence_count": (1, None), "complexity_score": (0, 9)}, ["section_type"]
    )
    _, rejected = quality.validate(cp.chunks(spark, folder).select("id", "meta"), rules)
    return rejected.select("id", F.array_join("reasons", ";").alias("reasons"))


@register
def request_validation(spark: SparkSession, folder: str) -> DataFrame:
    """Every conversation turn as a search request."""
    requests = cp.table(spark, folder, "conversations").select(
        "conv_id",
        "turn",
        F.col("text").alias("query_text"),
        F.when(F.col("role") == "user", F.array(F.lit(1.0).cast("float"))).alias("embedding"),
        F.lit("semantic").alias("search_type"),
        (F.col("turn") * 25).alias("limit"),
        (F.col("conv_id") % 21).alias("user_id"),
    )
    _, rejected = quality.validate(search.with_request_defaults(requests), quality.request_rules())
    return rejected.select("conv_id", "turn", F.array_join("reasons", ";").alias("reasons"))


# ---- predicates and projections


@register
def json_eq_bool_range(spark: SparkSession, folder: str) -> DataFrame:
    meta = F.col("meta")
    return (
        cp.chunks(spark, folder)
        .filter(
            (js.json_text(meta, "position") == "middle")
            & js.json_bool(meta, "has_math")
            & js.json_between(meta, "complexity_score", 3.0, 7.0)
            & (js.json_text(meta, "language_detected") == "en")
        )
        .select("id")
    )


@register
def json_key_exists(spark: SparkSession, folder: str) -> DataFrame:
    return cp.chunks(spark, folder).filter(js.json_has_key(F.col("meta"), "section_type")).select("id")


@register
def json_contains(spark: SparkSession, folder: str) -> DataFrame:
    return cp.chunks(spark, folder).filter(js.json_contains(F.col("meta"), {"position": "end", "has_list": True})).select("id")


@register
def json_contains_number(spark: SparkSession, folder: str) -> DataFrame:
    return cp.table(spark, folder, "events").filter(js.json_contains(F.col("props"), {"k": 69})).select("event_id")


def _json_index(spark: SparkSession, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    place = scratch(spark)
    jsonindex.write_json(rows, place)
    return jsonindex.read_json(spark, place)


@register
def json_postings_contains(spark: SparkSession, folder: str) -> DataFrame:
    """The containment filter from postings, without a parse."""
    index = _json_index(spark, cp.chunks(spark, folder).select("id", "meta"))
    return jsonindex.containing(*index, {"position": "end", "has_list": True})


@register
def json_postings_key(spark: SparkSession, folder: str) -> DataFrame:
    postings, _ = _json_index(spark, cp.chunks(spark, folder).select("id", "meta"))
    return jsonindex.having_key(postings, "section_type")


def _nested_meta(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with metadata that nests objects and arrays."""
    part = F.struct((F.col("doc_id") % 3).alias("n"), F.col("lang").alias("kind"))
    other = F.struct((F.col("doc_id") % 5).alias("n"), F.col("source").alias("kind"))
    whole = F.struct(
        "lang",
        F.struct((F.col("n_chars") > 1000).alias("long"), F.col("n_chars").alias("chars")).alias("stats"),
        F.array("lang", "source").alias("tags"),
        F.array(part, other).alias("parts"),
    )
    return cp.table(spark, folder, "documents").select(F.col("doc_id").alias("id"), F.to_json(whole).alias("meta"))


@register
def json_postings_nested(spark: SparkSession, folder: str) -> DataFrame:
    """Filters with objects in objects, arrays, and arrays of objects whose values must come from one element."""
    index = _json_index(spark, _nested_meta(spark, folder))
    result = None
    for name, wanted in NESTED_FILTERS.items():
        found = jsonindex.containing(*index, wanted).select(F.lit(name).alias("filter"), "id")
        result = found if result is None else result.unionByName(found)
    return result


@register
def date_and_length_filter(spark: SparkSession, folder: str) -> DataFrame:
    created = F.col("created_at") > F.lit(suite.CREATED_AFTER).cast("timestamp")
    return cp.chunks(spark, folder).filter(created & (F.length("text") > evalset.MIN_TEXT)).select("id")


@register
def metadata_defaults(spark: SparkSession, folder: str) -> DataFrame:
    value = js.json_default(js.json_double(F.col("meta"), "quality"), 5.0)
    return cp.documents(spark, folder).select("id", value.alias("quality"))


@register
def text_shapes(spark: SparkSession, folder: str) -> DataFrame:
    text = F.col("text")
    return cp.chunks(spark, folder).select(
        "id",
        tx.truncate(text, 200).alias("short"),
        tx.preview(text).alias("preview"),
        tx.iso_timestamp(F.col("created_at")).alias("created"),
        tx.keyword_query_text(text).alias("query_text"),
    )


@register
def vector_literals(spark: SparkSession, folder: str) -> DataFrame:
    """Every embedding written as text and read back."""
    parsed = vx.parse_vector(vx.format_vector(F.col("embedding")))
    total = F.aggregate(parsed, F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    return cp.table(spark, folder, "embeddings").select("vec_id", F.size(parsed).alias("n"), F.round(total, 5).alias("total"))


# ---- histograms


@register
def json_key_histogram(spark: SparkSession, folder: str) -> DataFrame:
    return histograms.key_histogram(cp.chunks(spark, folder))


@register
def json_value_histogram(spark: SparkSession, folder: str) -> DataFrame:
    return histograms.value_histogram(cp.chunks(spark, folder), "word_count")


@register
def json_value_summary(spark: SparkSession, folder: str) -> DataFrame:
    """The most frequent values of a key, proved by summaries and counted exactly."""
    values = cp.chunks(spark, folder).select(js.json_text(F.col("meta"), "word_count").alias("val"))
    return heavy.most_frequent(values, histograms.TOP_VALUES)


@register
def frequent_words(spark: SparkSession, folder: str) -> DataFrame:
    """The most frequent words of all chunks, where most distinct words are rare."""
    words = cp.chunks(spark, folder).select(F.explode(tokens(F.col("text"))).alias("val"))
    return heavy.most_frequent(words, 30)


@register
def json_frequent_values(spark: SparkSession, folder: str) -> DataFrame:
    return histograms.frequent_values(histograms.value_histogram(cp.chunks(spark, folder), "position"))


@register
def json_distinct_keys(spark: SparkSession, folder: str) -> DataFrame:
    return histograms.distinct_keys(cp.chunks(spark, folder))


@register
def users_over_threshold(spark: SparkSession, folder: str) -> DataFrame:
    return histograms.groups_over(cp.chunks(spark, folder))


# ---- semantic search


def _sample_vector(spark: SparkSession, folder: str) -> tuple[list[float], int]:
    """One query: the last embedding and the tenant of its document."""
    row = cp.table(spark, folder, "embeddings").orderBy(F.desc("vec_id")).select("vec_id", "embedding").first()
    return row["embedding"], 1 + row["vec_id"] % cp.TENANTS


def _embedded(spark: SparkSession, folder: str) -> DataFrame:
    return cp.chunks(spark, folder, embedded_only=True)


@register
def vector_topk(spark: SparkSession, folder: str) -> DataFrame:
    vector, _ = _sample_vector(spark, folder)
    return vec.nearest(_embedded(spark, folder), vector, 10, ["user_document_id"]).select("id", "user_document_id", r6("distance"))


@register
def vector_user(spark: SparkSession, folder: str) -> DataFrame:
    vector, user = _sample_vector(spark, folder)
    rows = _embedded(spark, folder)
    corpus = fusion.Corpus(rows, rows, rows, rows)
    return search.Searcher(spark, corpus).vector_search(user, vector).select("id", "user_document_id", "text", r6("distance"))


@register
def vector_key_exists(spark: SparkSession, folder: str) -> DataFrame:
    vector, _ = _sample_vector(spark, folder)
    rows = _embedded(spark, folder).filter(js.json_has_key(F.col("meta"), "section_type"))
    return vec.nearest(rows, vector, 10).select("id", r6("distance"))


def _ranked(found: DataFrame) -> DataFrame:
    return found.select("query_id", "id", "rank", r6("distance"))


@register
def vector_batch_user(spark: SparkSession, folder: str) -> DataFrame:
    scope = [vec.Scope("user_id", "user_id")]
    return _ranked(vec.nearest_batch(known_items(spark, folder), _embedded(spark, folder), 10, scope))


@register
def vector_batch_all(spark: SparkSession, folder: str) -> DataFrame:
    return _ranked(vec.nearest_batch(known_items(spark, folder), _embedded(spark, folder), 10))


@register
def vector_batch_shuffled(spark: SparkSession, folder: str) -> DataFrame:
    """Queries and chunks meet by shuffle, as they do in batches too large to be sent to every executor."""
    return _ranked(vec.nearest_shuffled(known_items(spark, folder), _embedded(spark, folder), 10, shard_bytes=SMALL_SHARD))


@register
def vector_user_shuffled(spark: SparkSession, folder: str) -> DataFrame:
    """The same inside each query's tenant."""
    scope = [vec.Scope("user_id", "user_id")]
    return _ranked(vec.nearest_shuffled(known_items(spark, folder), _embedded(spark, folder), 10, scope, shard_bytes=SMALL_SHARD))


@register
def vector_user_json(spark: SparkSession, folder: str) -> DataFrame:
    return _ranked(suite.simple_json_search(known_items(spark, folder), _embedded(spark, folder)))


@register
def vector_user_json_range(spark: SparkSession, folder: str) -> DataFrame:
    return _ranked(suite.complex_json_search(known_items(spark, folder), _embedded(spark, folder)))


def _scenario(run: Callable[..., DataFrame], strategy: str, design: str = "denorm", **how) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        score = "distance" if run is suite.vector_scenario else "relevance"
        found = run(known_items(spark, folder), cp.corpus(spark, folder), strategy, design, **how)
        return found.select("query_id", "id", "rank", r6(score))

    return query


REGISTRY["vector_contains"] = _scenario(suite.vector_scenario, "jsonb", json_filter=CHUNK_FILTER)
REGISTRY["vector_user_date"] = _scenario(suite.vector_scenario, "composite")
REGISTRY["vector_join_none"] = _scenario(suite.vector_scenario, "no_filter", "join")
REGISTRY["vector_join_user"] = _scenario(suite.vector_scenario, "user_id", "join")
REGISTRY["vector_join_json"] = _scenario(suite.vector_scenario, "jsonb", "join", json_filter=CHUNK_FILTER)


def _stored_clusters(spark: SparkSession, folder: str, n: int) -> tuple[DataFrame, ann.Clusters]:
    rows = cut_lineage(_embedded(spark, folder).select("id", "user_id", "embedding"))
    place = scratch(spark)
    ann.write_clusters(rows, ann.train(rows, n), place)
    return ann.read_clusters(spark, place)


@register
def ann_all_probes(spark: SparkSession, folder: str) -> DataFrame:
    """Approximate search over the stored clusters that probes every cluster is exact."""
    stored, clusters = _stored_clusters(spark, folder, 8)
    return _ranked(ann.search(known_items(spark, folder), stored, clusters, 10, 8))


@register
def ann_recall_sweep(spark: SparkSession, folder: str) -> DataFrame:
    stored, clusters = _stored_clusters(spark, folder, 16)
    queries = known_items(spark, folder)
    exact = cut_lineage(vec.nearest_batch(queries, stored.drop("cluster"), 10))
    return ann.recall_sweep(queries, stored, clusters, exact, 10, [1, 2, 4, 8, 16])


@register
def ann_recall_curve(spark: SparkSession, folder: str) -> DataFrame:
    """More probes never find less, and all probes find everything: what holds of the sweep whatever the centres."""
    swept = cut_lineage(ann_recall_sweep(spark, folder))
    return swept.agg(
        F.count("*").alias("efforts"),
        (F.array_sort(F.collect_list("recall")) == F.sort_array(F.collect_list(F.struct("probes", "recall")))["recall"]).alias(
            "never_falls"
        ),
        F.round(F.max_by("recall", "probes"), 6).alias("all_probes"),
    )


def _stored_codes(spark: SparkSession, folder: str, n: int) -> pq.Coded:
    rows = cut_lineage(_embedded(spark, folder).select("id", "user_id", "embedding"))
    place = scratch(spark)
    pq.write_codes(rows, ann.train(rows, n), place)
    return pq.read_codes(spark, place)


@register
def ann_codes_whole_pool(spark: SparkSession, folder: str) -> DataFrame:
    """Search over codes whose pool holds every vector is exact."""
    index = _stored_codes(spark, folder, 8)
    return _ranked(pq.search(known_items(spark, folder), index, 10, 8, index.vectors.count()))


@register
def ann_codes_recall(spark: SparkSession, folder: str) -> DataFrame:
    """Search over codes with a pool of ten times the result: whether recall at 10 reaches 0.9, and bytes read per vector."""
    index = _stored_codes(spark, folder, 16)
    queries = known_items(spark, folder)
    exact = cut_lineage(vec.nearest_batch(queries, index.vectors.drop("cluster"), 10)).select("query_id", "id")
    found = cut_lineage(pq.search(queries, index, 10, 16, 100)).select("query_id", "id")
    hits = found.join(exact, ["query_id", "id"], "left_semi").agg(F.count("*").alias("hits"))
    sizes = index.codes.agg(F.max(F.octet_length("code")).cast("long").alias("code_bytes"))
    whole = index.vectors.agg((F.max(F.size("embedding")) * 4).cast("long").alias("vector_bytes"))
    one = exact.agg(F.count("*").alias("n"), F.countDistinct("query_id").alias("queries"))
    parts = one
    for part in (hits, sizes, whole):
        parts = parts.unionByName(part, allowMissingColumns=True)
    return parts.agg(
        F.max("queries").alias("queries"),
        (F.max("hits") >= 0.9 * F.max("n")).alias("recall_reached"),
        F.max("code_bytes").alias("code_bytes"),
        F.max("vector_bytes").alias("vector_bytes"),
    )


@register
def layout_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks per tenant, read from the tenant's partition as the stored bucket count names it."""
    place = scratch(spark)
    layout.write_corpus(cp.documents(spark, folder), cp.chunks(spark, folder), place, "simple", buckets=8)
    corpus = layout.read_corpus(spark, place)
    own = F.col("user_bucket") == fusion.user_bucket(F.col("user_id"), corpus.user_buckets)
    return corpus.chunks.filter(own).groupBy("user_id").agg(F.count("*").alias("n_chunks"))


# ---- keyword search


@register
def postings_simple(spark: SparkSession, folder: str) -> DataFrame:
    lines = keyword.postings(keyword.text_index(cp.chunks(spark, folder), "simple"))
    return lines.select("lexeme", "id", "user_id", F.array_join("positions", ",").alias("positions"))


@register
def vocabulary_simple(spark: SparkSession, folder: str) -> DataFrame:
    return keyword.vocabulary(keyword.text_index(cp.chunks(spark, folder), "simple"))


def _found(found: DataFrame) -> DataFrame:
    return found.select("query_id", "id", "rank", r6("relevance"))


def _keyword(queries: Callable[[SparkSession, str], DataFrame], k: int = 10, **how) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        index = keyword.text_index(cp.chunks(spark, folder), how.get("dictionary", "simple"))
        return _found(keyword.keyword_topk(queries(spark, folder), index, k, **{"dictionary": "simple", **how}))

    return query


def _short(spark: SparkSession, folder: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(SHORT_QUERIES, 1)), "query_id long, query_text string")


def _from_benchmark(shape: Callable[[Column], Column]) -> Callable[[SparkSession, str], DataFrame]:
    """One query per benchmark text, put together from its words."""

    def queries(spark: SparkSession, folder: str) -> DataFrame:
        words = F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
        return cp.table(spark, folder, "benchmark").select(
            F.col("item_id").alias("query_id"), (1 + F.col("item_id") % cp.TENANTS).alias("user_id"), shape(words).alias("query_text")
        )

    return queries


REGISTRY["keyword_user"] = _keyword(known_items)
REGISTRY["keyword_all"] = _keyword(known_items, scoped=False)
REGISTRY["keyword_short"] = _keyword(_short, k=100, scoped=False)
REGISTRY["keyword_shuffle_join"] = _keyword(known_items, small=False)
REGISTRY["keyword_english"] = _keyword(known_items, dictionary="english")
_phrase = _from_benchmark(lambda w: F.concat(F.lit('"'), w[0], F.lit(" "), w[1], F.lit('" '), w[2]))
_or_not = _from_benchmark(
    lambda w: F.concat(w[0], F.lit(" "), w[1], F.lit(' or "'), w[2], F.lit(" "), w[3], F.lit('" -'), w[4])
)
REGISTRY["keyword_phrase"] = _keyword(_phrase, scoped=False)
REGISTRY["keyword_or_not"] = _keyword(_or_not)
_negative = _from_benchmark(lambda w: F.concat(F.lit("-"), w[0], F.lit(' -"'), w[1], F.lit(" "), w[2], F.lit('"')))
REGISTRY["keyword_only_negative"] = _keyword(_negative)


@register
def keyword_negative_postings(spark: SparkSession, folder: str) -> DataFrame:
    """Exclusions without any required word, from postings."""
    index = keyword.text_index(cp.chunks(spark, folder), "simple")
    lines = cut_lineage(keyword.postings(index).unionByName(keyword.chunk_postings(index)))
    return _found(keyword.keyword_topk(_negative(spark, folder), index, 10, dictionary="simple", lines=lines))


@register
def keyword_vocabulary_anchor(spark: SparkSession, folder: str) -> DataFrame:
    """The rarest word of a query leads to its candidates."""
    index = keyword.text_index(cp.chunks(spark, folder), "simple")
    queries = known_items(spark, folder)
    return _found(keyword.keyword_topk(queries, index, 10, dictionary="simple", known=keyword.vocabulary(index)))


def _stored_blocks(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Block postings, postings and vocabulary of the chunks, as a corpus stores them."""
    place = scratch(spark)
    layout.write_corpus(cp.documents(spark, folder), cp.chunks(spark, folder), place, "simple", buckets=8, blocks=True)
    corpus = layout.read_corpus(spark, place, use_blocks=True, use_vocabulary=True)
    return corpus.blocks, corpus.postings, corpus.vocabulary


def _keyword_blocks(queries: Callable[[SparkSession, str], DataFrame], k: int = 10, scoped: bool = True) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        blocks, lines, known = _stored_blocks(spark, folder)
        asked = cut_lineage(queries(spark, folder))
        return _found(blockmax.block_topk(asked, blocks, lines, k, "simple", scoped, known)[0])

    return query


REGISTRY["keyword_block_user"] = _keyword_blocks(known_items)
REGISTRY["keyword_block_short"] = _keyword_blocks(_short, 100, scoped=False)
REGISTRY["keyword_block_phrase"] = _keyword_blocks(_phrase, scoped=False)
REGISTRY["keyword_block_or_not"] = _keyword_blocks(_or_not)
REGISTRY["keyword_block_negative"] = _keyword_blocks(_negative)


@register
def keyword_blocks_read(spark: SparkSession, folder: str) -> DataFrame:
    """For the most frequent words: postings in all, whether fewer are read for smaller k, and whether ten need all of them."""
    blocks, lines, known = _stored_blocks(spark, folder)
    words = known.orderBy(F.desc("n_chunks"), "lexeme").limit(30)
    number = F.row_number().over(Window.orderBy(F.desc("n_chunks"), "lexeme")).cast("long")
    queries = cut_lineage(words.select(number.alias("query_id"), F.col("lexeme").alias("query_text")))
    result = queries
    for k in READ_AT:
        read = blockmax.block_topk(queries, blocks, lines, k, "simple", False, known)[1]
        result = result.join(read.select("query_id", "postings", F.col("postings_read").alias(f"read_{k}")), "query_id")
        result = result.drop("postings") if k != READ_AT[-1] else result
    falls = F.lit(True)
    for low, high in itertools.pairwise([f"read_{k}" for k in READ_AT] + ["postings"]):
        falls &= F.col(low) <= F.col(high)
    return result.select(F.col("query_text").alias("lexeme"), "postings", falls.alias("falls"))


REGISTRY["keyword_json"] = _scenario(suite.text_scenario, "jsonb", json_filter=CHUNK_FILTER)
REGISTRY["keyword_user_date"] = _scenario(suite.text_scenario, "composite")
REGISTRY["keyword_join_none"] = _scenario(suite.text_scenario, "no_filter", "join")
REGISTRY["keyword_join_user"] = _scenario(suite.text_scenario, "user_id", "join")
REGISTRY["keyword_join_json"] = _scenario(suite.text_scenario, "jsonb", "join", json_filter=CHUNK_FILTER)

# ---- hybrid search


def _fused(**parameters) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        found = fusion.hybrid_ids(known_items(spark, folder), cp.corpus(spark, folder), **parameters)
        return found.select("query_id", "id", "rank", r6("k_score"), r6("v_score"), r6("score"))

    return query


def _with_text(found: DataFrame) -> DataFrame:
    return found.select(
        "query_id", "rank", "id", "user_document_id", "paragraph_id", "text", r6("k_score"), r6("v_score"), r6("score")
    )


@register
def hybrid_rrf(spark: SparkSession, folder: str) -> DataFrame:
    return _with_text(fusion.hybrid_search(known_items(spark, folder), cp.corpus(spark, folder)))


@register
def hybrid_layout(spark: SparkSession, folder: str) -> DataFrame:
    """The hybrid search over tables written in the tenant layout."""
    place = scratch(spark)
    layout.write_corpus(cp.documents(spark, folder), cp.chunks(spark, folder), place, "simple", buckets=8)
    return _with_text(
        fusion.hybrid_search(known_items(spark, folder), layout.read_corpus(spark, place))
    )



@register
def keyword_postings(spark: SparkSession, folder: str) -> DataFrame:
    """Keyword search that reads stored postings only."""
    place = scratch(spark)
    layout.write_corpus(cp.documents(spark, folder), cp.chunks(spark, folder), place, "simple", buckets=8)
    corpus = layout.read_corpus(spark, place, use_postings=True, use_vocabulary=True)
    return _found(fusion.text_pool(known_items(spark, folder), corpus, 10))


def _grown(spark: SparkSession, folder: str, **tables) -> fusion.Corpus:
    """A corpus that came in three batches, one of them twice, of which the first two were compacted."""
    place = scratch(spark)
    rows = cp.chunks(spark, folder)
    batch = F.pmod(F.xxhash64("user_document_id"), F.lit(3))
    for number in range(3):
        incremental.append(rows.filter(batch == number), place, number, "simple", 8)
    incremental.append(rows.filter(batch == 1), place, 1)
    # rows that are there already, under a new number, add nothing
    incremental.append(rows.filter(batch == 1), place, 3)
    incremental.compact(spark, place, [0, 1])
    return incremental.read(spark, place, cp.documents(spark, folder), **tables)


@register
def incremental_hybrid(spark: SparkSession, folder: str) -> DataFrame:
    """The hybrid search over tables grown by batches."""
    return _with_text(fusion.hybrid_search(known_items(spark, folder), _grown(spark, folder)))


@register
def incremental_vocabulary(spark: SparkSession, folder: str) -> DataFrame:
    return _grown(spark, folder, use_vocabulary=True).vocabulary


@register
def incremental_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Keyword search over block postings and vocabulary grown by batches."""
    corpus = _grown(spark, folder, use_blocks=True, use_vocabulary=True)
    return _found(fusion.text_pool(known_items(spark, folder), corpus, 10))


REGISTRY["hybrid_chunk_filter"] = _fused(chunk_filter=CHUNK_FILTER)
REGISTRY["hybrid_doc_filter"] = _fused(chunk_filter=CHUNK_FILTER, doc_filter=DOCUMENT_FILTER)
REGISTRY["hybrid_capped"] = _fused(match_count=100)


@register
def hybrid_weights(spark: SparkSession, folder: str) -> DataFrame:
    found = fusion.weight_sweep(known_items(spark, folder), cp.corpus(spark, folder))
    return found.select("weights", "query_id", "id", "rank", r6("score"))


@register
def hybrid_two_query(spark: SparkSession, folder: str) -> DataFrame:
    found = fusion.hybrid_two_query(known_items(spark, folder), cp.corpus(spark, folder))
    return found.select("query_id", "chunk_id", "text_rank", "vector_rank", r6("rrf_score"), "rank")


@register
def hybrid_weighted_raw(spark: SparkSession, folder: str) -> DataFrame:
    found = fusion.hybrid_raw(known_items(spark, folder), cp.corpus(spark, folder), 1.0, 2.0)
    return found.select("query_id", "id", r6("k_score"), r6("v_score"), r6("score"), "rank")


def _plain(scope: str) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        found = fusion.hybrid_plain(known_items(spark, folder), cp.corpus(spark, folder), scope=scope)
        return found.select("query_id", "id", "rank", r6("score"))

    return query


REGISTRY["hybrid_plain_none"] = _plain("none")
REGISTRY["hybrid_plain_user"] = _plain("user")
REGISTRY["hybrid_plain_join"] = _plain("join")

# ---- results, parents, responses


def _results(spark: SparkSession, folder: str) -> tuple[DataFrame, fusion.Corpus, DataFrame]:
    queries, corpus = known_items(spark, folder), cp.corpus(spark, folder)
    ranked = fusion.hybrid_ids(queries, corpus)
    rows = fusion.with_payload(ranked, queries, corpus, fusion.MAX_RESULTS).select(
        "query_id", "user_id", "rank", F.col("id").alias("chunk_id"), F.col("user_document_id").alias("document_id"), "score"
    )
    return rows, corpus, queries


@register
def parent_fetch(spark: SparkSession, folder: str) -> DataFrame:
    rows, corpus, _ = _results(spark, folder)
    return enrich.fetch_parents(rows, corpus.documents).select("id", "user_id", "title", "url")


@register
def enriched_results(spark: SparkSession, folder: str) -> DataFrame:
    rows, corpus, _ = _results(spark, folder)
    parents = enrich.fetch_parents(rows, corpus.documents)
    return enrich.enrich(rows, parents).select(
        "query_id", "rank", "chunk_id", r6("score"),
        F.col("document.title").alias("document_title"), F.col("document.url").alias("document_url"),
    )


@register
def first_document_ranks(spark: SparkSession, folder: str) -> DataFrame:
    return enrich.first_ranks(_results(spark, folder)[0]).select("query_id", "document_id", "first_rank")


@register
def ground_truth_rank(spark: SparkSession, folder: str) -> DataFrame:
    queries = known_items(spark, folder)
    found = fusion.hybrid_ids(queries, cp.corpus(spark, folder))
    return metrics.ground_truth_ranks(queries, found).select(
        "query_id", "ground_truth_rank", "found_ground_truth", "result_count"
    )


def _requests(spark: SparkSession, folder: str) -> DataFrame:
    """Every known item as a request; type and size follow from its document."""
    document = F.col("ground_truth_document_id")
    kind = F.when(document % 3 == 0, "semantic").when(document % 3 == 1, "keyword").otherwise("hybrid")
    return known_items(spark, folder).select(
        "query_id", "user_id", "query_text", F.col("query_embedding").alias("embedding"), kind.alias("search_type"),
        (1 + document % 12).cast("int").alias("limit"),
    )


@register
def search_results(spark: SparkSession, folder: str) -> DataFrame:
    requests = _requests(spark, folder)
    results, _ = search.search_batch(requests, cp.corpus(spark, folder))
    return results.join(requests.select("query_id", "search_type"), "query_id").select(
        "query_id", "search_type", "rank", "chunk_id", "document_id", "text", r6("score")
    )


@register
def search_response(spark: SparkSession, folder: str) -> DataFrame:
    requests = _requests(spark, folder)
    results, _ = search.search_batch(requests, cp.corpus(spark, folder))
    ids = F.array_join(F.transform("results", lambda r: r["chunk_id"].cast("string")), ",")
    return enrich.responses(requests, results).select(
        "query_id", "search_type", "query_text", "total_results", F.nullif(ids, F.lit("")).alias("chunk_ids")
    )


# ---- evaluation sets


@register
def known_item_set(spark: SparkSession, folder: str) -> DataFrame:
    return evalset.as_known_items(_embedded(spark, folder)).select("id", "user_id", "search_text")


@register
def known_item_sample(spark: SparkSession, folder: str) -> DataFrame:
    return evalset.known_items(cp.chunks(spark, folder), 30).select("id", "user_id", "search_text", "user_document_id")


@register
def block_sample_report(spark: SparkSession, folder: str) -> DataFrame:
    """A stored table drawn by files: the same rows twice, all of them the table's, and a whole share is the whole table."""
    place = f"{scratch(spark)}/chunks"
    cp.chunks(spark, folder).select("id", "text").repartition(64, "id").write.parquet(place)
    table = spark.read.parquet(place).select("id")
    drawn = [sampling.block_sample(spark, place, evalset.SAMPLE_SHARE * 10, seed=3).select("id") for _ in range(2)]
    sides = drawn[0].withColumn("side", F.lit(1)).unionByName(drawn[1].withColumn("side", F.lit(2)))
    pairs = sides.groupBy("id").agg(F.sum("side").alias("sides"))
    joined = pairs.join(table.select("id", F.lit(True).alias("held")), "id", "left")
    whole = sampling.block_sample(spark, place, 1.0).agg(F.count("*").alias("whole"))
    checked = joined.agg(F.bool_and(F.col("sides") == 3).alias("repeats"), F.bool_and(F.coalesce("held", F.lit(False))).alias("inside"))
    both = checked.unionByName(whole, allowMissingColumns=True)
    return both.agg(F.bool_and("repeats").alias("repeats"), F.bool_and("inside").alias("inside"), F.max("whole").alias("whole"))


@register
def random_documents(spark: SparkSession, folder: str) -> DataFrame:
    return evalset.random_documents(cp.documents(spark, folder), cp.chunks(spark, folder), 50).select("document_id", "chunk_id", "user_id")


def _one_chunk_each(spark: SparkSession, folder: str) -> DataFrame:
    documents, chunks = cp.documents(spark, folder), cp.chunks(spark, folder)
    return evalset.with_chunks(evalset.one_chunk_per_document(documents, chunks, key=F.col("id")), documents, chunks)


@register
def one_chunk_per_doc(spark: SparkSession, folder: str) -> DataFrame:
    return _one_chunk_each(spark, folder).select("document_id", "document_title", "user_id", "chunk_id", "paragraph_id")


@register
def attach_queries(spark: SparkSession, folder: str) -> DataFrame:
    """Conversation turns stand in for generated texts: a conversation is a batch."""
    by_id = ([F.col("document_id")], F.floor(F.col("document_id") / ingest.ORDINAL_BLOCK))
    documents = evalset.number_batches(_one_chunk_each(spark, folder), by_id)
    generated = (
        cp.table(spark, folder, "conversations")
        .groupBy(F.col("conv_id").alias("batch"))
        .agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("queries"))
    )
    return evalset.attach_queries(documents, generated).select(
        "query_id", "query_text", "ground_truth_chunk_id", "ground_truth_document_id", "document_title", "chunk_text_preview"
    )


@register
def evaluation_files(spark: SparkSession, folder: str) -> DataFrame:
    """An evaluation set written as table and sidecar, and read back."""
    place = scratch(spark)
    queries = known_items(spark, folder).select(
        "query_id", "query_text", "ground_truth_chunk_id", "ground_truth_document_id",
        F.col("user_id").alias("ground_truth_user_id"), "ground_truth_paragraph_id",
        F.lit("title").alias("document_title"), tx.preview(F.col("query_text")).alias("chunk_text_preview"), "meta",
        "query_embedding", F.col("query_embedding").alias("document_embedding"),
    )
    evalfiles.write_evaluation_set(queries, f"{place}/queries", f"{place}/vectors")
    read = evalfiles.read_evaluation_set(spark, f"{place}/queries", f"{place}/vectors")
    total = F.aggregate("query_embedding", F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    return read.select(
        "query_id", "query_text", "ground_truth_chunk_id", "ground_truth_user_id",
        js.json_text(F.col("meta"), "position").alias("position"), F.round(total, 4).alias("vector_sum"),
    )


@register
def evaluation_tenants(spark: SparkSession, folder: str) -> DataFrame:
    return evalset.tenants_of(known_items(spark, folder).withColumnRenamed("user_id", "ground_truth_user_id"))


@register
def sample_parameters(spark: SparkSession, folder: str) -> DataFrame:
    return evalset.sample_parameters(cp.chunks(spark, folder)).select(
        "user_id", F.size("embedding").alias("n"), js.json_text(F.col("meta"), "position").alias("position")
    )


# ---- metrics


def _runs(spark: SparkSession, folder: str) -> DataFrame:
    """Events stand in for measured runs: their value is the latency, their property the rank."""
    k = js.json_text(F.col("props"), "k").cast("long")
    kind = F.when(F.col("event_id") % 3 == 0, "vector").when(F.col("event_id") % 3 == 1, "text").otherwise("hybrid")
    strategy = (
        F.when(F.col("event_type") == "view", "no_filter")
        .when(F.col("event_type") == "click", "user_id")
        .when(F.col("event_type") == "purchase", "jsonb")
        .otherwise("composite")
    )
    return cp.table(spark, folder, "events").select(
        "event_id",
        F.col("event_type").alias("search_type"),
        F.when(F.col("user_id") % 2 == 0, "user_only").otherwise("no_filter").alias("filter_type"),
        F.col("value").alias("latency_ms"),
        F.nullif(k % 16, F.lit(0).cast("long")).alias("ground_truth_rank"),
        kind.alias("kind"),
        strategy.alias("filter_strategy"),
        F.when(F.col("user_id") % 2 == 0, "denorm").otherwise("join").alias("schema_design"),
    )


def _configs(spark: SparkSession, folder: str) -> DataFrame:
    runs = _runs(spark, folder).drop("search_type").withColumnRenamed("kind", "search_type")
    labelled = runs.withColumn("config", tx.config_label(F.col("search_type"), F.col("schema_design"), F.col("filter_strategy")))
    return metrics.config_metrics(labelled, ["config", "search_type", "filter_strategy", "schema_design"])


@register
def run_metrics(spark: SparkSession, folder: str) -> DataFrame:
    found = metrics.run_metrics(_runs(spark, folder))
    return found.select(
        "search_type", "filter_type", r6("mean"), r6("median"), r6("stdev"), r6("recall"), r6("hit_rate_at_10"),
        "total_queries", "found",
    )


@register
def percentile_rule(spark: SparkSession, folder: str) -> DataFrame:
    return _configs(spark, folder).select(
        "config", r6("avg_ms"), r6("median_ms"), "p95_ms", "p99_ms", "min_ms", "max_ms", r6("std_dev"), r6("recall"), r6("mrr"),
        r6("qps"),
    )


@register
def quality_report(spark: SparkSession, folder: str) -> DataFrame:
    runs = _runs(spark, folder).drop("search_type").withColumnRenamed("kind", "search_type")
    found = metrics.quality_report(runs)
    exact = ["search_type", "found", "total_queries"]
    return found.select(*[c if c in exact else r6(c) for c in found.columns])


@register
def best_config(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.best_configs(_configs(spark, folder)).select("search_type", "config", r6("avg_ms"))


@register
def run_summary(spark: SparkSession, folder: str) -> DataFrame:
    found = metrics.run_summary(_configs(spark, folder))
    return found.select(*[c if c == "total_tests" else r6(c) for c in found.columns])


@register
def filter_impact(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.filter_impact(_configs(spark, folder)).select("search_type", r6("user_speedup"), r6("jsonb_speedup"))


@register
def schema_impact(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.schema_impact(_configs(spark, folder), 0.99).select("search_type", "filter_strategy", r6("speedup"))


@register
def method_comparison(spark: SparkSession, folder: str) -> DataFrame:
    half = F.col("latency_ms") * 0.5
    runs = _runs(spark, folder).select(
        F.col("schema_design").alias("method"), "latency_ms", "ground_truth_rank", half.alias("vector_ms"),
        half.alias("text_ms"), half.alias("rrf_ms"),
    )
    return metrics.method_comparison(runs).select("method", r6("mean"), r6("median"), r6("recall"), r6("vector_ms"), r6("vector_share"))


@register
def join_comparison(spark: SparkSession, folder: str) -> DataFrame:
    variant = F.when(F.col("schema_design") == "join", "with_join").otherwise("without_join")
    found = metrics.join_comparison(_runs(spark, folder).select(variant.alias("variant"), "latency_ms"))
    return found.select(*[r6(c) for c in found.columns])


@register
def timing_reports(spark: SparkSession, folder: str) -> DataFrame:
    """Report lines made from events, parsed and reduced to the last value per label."""
    label = (
        F.when(F.col("event_type") == "view", "Planning Time")
        .when(F.col("event_type") == "click", "Execution Time")
        .when(F.col("event_type") == "purchase", "Total Time")
        .otherwise("Rows")
    )
    lines = cp.table(spark, folder, "events").select(
        F.concat(F.lit("report_"), F.col("user_id").cast("string")).alias("name"),
        F.col("event_id").alias("line_no"),
        F.concat(label, F.lit(": "), F.format_string("%.2f", F.col("value")), F.lit(" ms")).alias("value"),
    )
    return timing.ranked_timings(timing.timings(lines))


@register
def config_table(spark: SparkSession, folder: str) -> DataFrame:
    return evalfiles.config_table(_configs(spark, folder)).select(
        "config", "search_type", "filter_strategy", "schema_design", "avg_ms", "qps"
    )


@register
def suite_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Every scenario over every known item: how often and how high the expected chunk is found."""
    runs = suite.run_suite(known_items(spark, folder), cp.corpus(spark, folder))
    report = metrics.quality_report(runs.withColumn("latency_ms", F.lit(None).cast("double")), ["search_type", "filter_type"])
    return _rounded(report.drop("mean_ms"))


def _rounded(report: DataFrame) -> DataFrame:
    return report.select(*[r6(c) if t == "double" else c for c, t in report.dtypes])


@register
def matrix_quality(spark: SparkSession, folder: str) -> DataFrame:
    runs = suite.run_matrix(
        known_items(spark, folder), cp.corpus(spark, folder), CHUNK_FILTER, DOCUMENT_FILTER
    )
    report = metrics.quality_report(runs.withColumn("latency_ms", F.lit(None).cast("double")), ["config"])
    return _rounded(report.drop("mean_ms"))
