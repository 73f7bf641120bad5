"""Evaluation suites: every scenario answers the whole query table in one job, then expected answers are located."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinseek.functions.json import json_contains, json_has_key
from twinseek.operators import fusion, metrics
from twinseek.operators.fusion import Corpus, owned, text_pool, vector_pool
from twinseek.operators.ranking import top_k_per_query
from twinseek.operators.settings import Setting, keyword_settings, nearest_settings
from twinseek.operators.sizing import fits_broadcast
from twinseek.operators.vector import Range, Scope, nearest_batch
from twinseek.session import cut_lineage

# Date bound of the composite filter, language and half-width of the complexity filter, its default and the
# defaults of the simple filter, results per query.
CREATED_AFTER = "2024-01-01"
LANGUAGE = "en"
COMPLEXITY_WIDTH = 2.0
META_DEFAULTS = {"position": "middle", "has_code": False, "complexity_score": 5.0}
LIMIT = 10

STRATEGIES = ["no_filter", "user_id", "jsonb", "composite"]
DESIGNS = ["denorm", "join"]
SCENARIOS = {
    "vector": ["no_filter", "user_only", "user_jsonb", "user_jsonb_complex"],
    "text": ["no_filter", "user_only"],
    "hybrid": ["user_only"],
    "hybrid_two_queries": ["user_only"],
}


HYBRIDS = ("hybrid", "hybrid_two_queries")


def strategy_filter(strategy: str, json_filter: dict | None = None, key: str | None = None) -> Column | None:
    """Chunk condition of a strategy, apart from the tenant."""
    if strategy == "jsonb":
        return json_contains(F.col("meta"), json_filter)
    if strategy == "composite":
        return F.col("created_at") > F.lit(CREATED_AFTER).cast("timestamp")
    if strategy in ("key", "user_key"):
        return json_has_key(F.col("meta"), key)
    return None


def is_scoped(strategy: str) -> bool:
    return strategy in ("user_id", "composite", "user_key")


def _side(corpus: Corpus, design: str) -> Corpus:
    if design == "denorm":
        return corpus
    documents = corpus.documents
    return replace(
        corpus,
        text=owned(corpus.text, documents),
        vectors=owned(corpus.vectors, documents),
        postings=None,
        blocks=None,
        user_buckets=None,
    )


def vector_scenario(
    queries: DataFrame, corpus: Corpus, strategy: str, design: str = "denorm", k: int = LIMIT, **how
) -> DataFrame:
    return vector_pool(queries, _side(corpus, design), k, strategy_filter(strategy, **how), is_scoped(strategy))


def text_scenario(
    queries: DataFrame, corpus: Corpus, strategy: str, design: str = "denorm", k: int = LIMIT, **how
) -> DataFrame:
    return text_pool(queries, _side(corpus, design), k, strategy_filter(strategy, **how), is_scoped(strategy))


def hybrid_scenario(
    queries: DataFrame, corpus: Corpus, strategy: str, json_filter: dict | None = None, doc_filter: dict | None = None, k: int = LIMIT
) -> DataFrame:
    """`user_id`: tenant only; `jsonb`: with a chunk filter; `composite`: with a chunk and a document filter."""
    return fusion.hybrid_ids(
        queries,
        corpus,
        match_count=k,
        chunk_filter=json_filter if strategy in ("jsonb", "composite") else None,
        doc_filter=doc_filter if strategy == "composite" else None,
    )


def simple_json_search(queries: DataFrame, vectors: DataFrame, k: int = LIMIT) -> DataFrame:
    """Tenant, position and code flag must equal the query's own (with defaults where it has none)."""
    wanted = queries.withColumns(
        {c: F.coalesce(F.col(c), F.lit(META_DEFAULTS[c])) for c in ("position", "has_code")}
    )
    scopes = [Scope("user_id", "user_id"), Scope("position", "position"), Scope("has_code", "has_code")]
    return nearest_batch(wanted, vectors, k, scopes)


def complex_json_search(queries: DataFrame, vectors: DataFrame, k: int = LIMIT, language: str = LANGUAGE) -> DataFrame:
    """Tenant equal, complexity near the query's own, language fixed."""
    near = F.coalesce(F.col("complexity_score"), F.lit(META_DEFAULTS["complexity_score"]))
    wanted = queries.withColumn("low", F.greatest(F.lit(0.0), near - COMPLEXITY_WIDTH)).withColumn(
        "high", near + COMPLEXITY_WIDTH
    )
    return nearest_batch(
        wanted,
        vectors.filter(F.col("language_detected") == language),
        k,
        [Scope("user_id", "user_id")],
        [Range("complexity_score", "low", "high")],
    )


def scenario(queries: DataFrame, corpus: Corpus, search_type: str, filter_type: str, k: int = LIMIT) -> DataFrame:
    """Ranked ids of one scenario: `query_id, id, rank`."""
    scoped = filter_type != "no_filter"
    if search_type == "vector" and filter_type == "user_jsonb":
        found = simple_json_search(queries, corpus.vectors, k)
    elif search_type == "vector" and filter_type == "user_jsonb_complex":
        found = complex_json_search(queries, corpus.vectors, k)
    elif search_type == "vector":
        found = vector_pool(queries, corpus, k, scoped=scoped)
    elif search_type == "text":
        found = text_pool(queries, corpus, k, scoped=scoped)
    elif search_type == "hybrid" and scoped:
        found = fusion.hybrid_ids(queries, corpus, match_count=k)
    elif search_type == "hybrid_two_queries" and scoped:
        found = fusion.hybrid_two_query(queries, corpus, k).withColumnRenamed("chunk_id", "id")
    else:
        raise ValueError(f"no scenario {search_type}/{filter_type}")
    return found.select("query_id", "id", "rank")


def with_query_bounds(queries: DataFrame) -> DataFrame:
    """The queries with the values that the JSON scenarios compare with: their own, or the defaults."""
    near = F.coalesce(F.col("complexity_score"), F.lit(META_DEFAULTS["complexity_score"]))
    return queries.withColumns(
        {
            "asked_position": F.coalesce(F.col("position"), F.lit(META_DEFAULTS["position"])),
            "asked_has_code": F.coalesce(F.col("has_code"), F.lit(META_DEFAULTS["has_code"])),
            "low": F.greatest(F.lit(0.0), near - COMPLEXITY_WIDTH),
            "high": near + COMPLEXITY_WIDTH,
        }
    )


USER = Scope("user_id", "user_id")


def suite_settings(scenarios: dict[str, list[str]], k: int = LIMIT) -> tuple[list[Setting], list[Setting]]:
    """What the scenarios ask of the vectors and of the text index, by `search type/filter type`."""
    vectors, texts = [], []
    for kind, names in scenarios.items():
        for name in names:
            label = f"{kind}/{name}"
            tenant = [] if name == "no_filter" else [USER]
            if kind == "vector" and name == "user_jsonb":
                own = [Scope("position", "asked_position"), Scope("has_code", "asked_has_code")]
                vectors.append(Setting(label, k, [USER, *own]))
            elif kind == "vector" and name == "user_jsonb_complex":
                near = Range("complexity_score", "low", "high")
                vectors.append(Setting(label, k, [USER], F.col("language_detected") == LANGUAGE, near))
            elif kind == "vector" and name in ("no_filter", "user_only"):
                vectors.append(Setting(label, k, tenant))
            elif kind == "text" and name in ("no_filter", "user_only"):
                texts.append(Setting(label, k, tenant))
            elif kind in HYBRIDS and name == "user_only":
                pool = min(k, fusion.MAX_RESULTS) * fusion.POOL_FACTOR if kind == "hybrid" else fusion.TWO_QUERY_POOL
                vectors.append(Setting(label, pool, tenant))
                texts.append(Setting(label, pool, tenant))
            else:
                raise ValueError(f"no scenario {kind}/{name}")
    return vectors, texts


def _answers(
    queries: DataFrame, corpus: Corpus, vectors: list[Setting], texts: list[Setting]
) -> tuple[DataFrame | None, DataFrame | None]:
    """Both legs of all settings, each from one scan, as stored tables."""
    near = cut_lineage(nearest_settings(queries, corpus.vectors, vectors)) if vectors else None
    found = keyword_settings(queries, corpus.text, texts, corpus.dictionary, corpus.vocabulary) if texts else None
    return near, None if found is None else cut_lineage(found)


def _of(found: DataFrame | None, label: str) -> DataFrame:
    return found.filter(F.col("name") == label).drop("name")


def run_suite(queries: DataFrame, corpus: Corpus, scenarios: dict[str, list[str]] | None = None, k: int = LIMIT) -> DataFrame:
    """All scenarios over all queries: `search_type, filter_type, query_id, ..., found_ground_truth, ground_truth_rank`.

    The vectors and the text index are read once each, whatever the number of scenarios.
    """
    scenarios = scenarios or SCENARIOS
    bounded = cut_lineage(with_query_bounds(queries))
    near, found = _answers(bounded, corpus, *suite_settings(scenarios, k))
    results = []
    for kind, names in scenarios.items():
        for name in names:
            label = f"{kind}/{name}"
            if kind in HYBRIDS:
                fused = fusion.fuse(_of(found, label), _of(near, label))
                scored = (
                    fusion.rrf_scores(fused, fusion.RRF_K)
                    if kind == "hybrid"
                    else fusion.rrf_scores(fused, fusion.TWO_QUERY_RRF_K, missing_rank=fusion.MISSING_RANK)
                )
                ranked = top_k_per_query(scored, "score", min(k, fusion.MAX_RESULTS) if kind == "hybrid" else k, descending=True)
            else:
                ranked = _of(near if kind == "vector" else found, label)
            results.append(ranked.select(F.lit(label).alias("label"), "query_id", "id", "rank"))
    ranks = metrics.labelled_ranks(queries, _union(results), [f"{kind}/{name}" for kind, names in scenarios.items() for name in names])
    kinds = F.split("label", "/")
    return ranks.withColumn("search_type", kinds[0]).withColumn("filter_type", kinds[1]).drop("label")


def matrix(has_json_filter: bool = True) -> list[tuple[str, str, str]]:
    """Configurations `(search type, strategy, design)`: vector and text in both designs, hybrid per strategy.

    The composite strategy has no joined form; JSON strategies need a filter.
    """
    rows = [
        (kind, strategy, design)
        for kind in ("vector", "text")
        for design in DESIGNS
        for strategy in STRATEGIES
        if not (design == "join" and strategy == "composite")
    ]
    rows += [("hybrid", strategy, "function") for strategy in ("user_id", "jsonb", "composite")]
    needs = lambda kind, strategy: strategy == "jsonb" or (kind == "hybrid" and strategy == "composite")
    return [r for r in rows if has_json_filter or not needs(r[0], r[1])]


def matrix_settings(
    rows: list[tuple[str, str, str]], json_filter: dict | None, k: int = LIMIT
) -> tuple[list[Setting], list[Setting]]:
    """What the configurations ask of the vectors and of the text index, by their label."""
    vectors, texts = [], []
    # configurations that ask the same share one condition, by which they are known to
    contains = None if json_filter is None else json_contains(F.col("meta"), json_filter)
    strategies = {s: contains if s == "jsonb" else strategy_filter(s, json_filter) for s in STRATEGIES}
    # orphans have no document to join
    has_owner = F.col("owner").isNotNull()
    joined = {s: has_owner if c is None else c & has_owner for s, c in strategies.items()}
    for kind, strategy, design in rows:
        label = config_label(kind, strategy, design)
        if kind == "hybrid":
            pool = min(k, fusion.MAX_RESULTS) * fusion.POOL_FACTOR
            condition = contains if strategy in ("jsonb", "composite") else None
            vectors.append(Setting(label, pool, [USER], condition))
            texts.append(Setting(label, pool, [USER], condition))
            continue
        condition = (joined if design == "join" else strategies)[strategy]
        owner = "user_id" if design == "denorm" else "owner"
        scopes = [Scope(owner, "user_id")] if is_scoped(strategy) else []
        (vectors if kind == "vector" else texts).append(Setting(label, k, scopes, condition))
    return vectors, texts


def config_label(kind: str, strategy: str, design: str) -> str:
    # fixed values: form of the label, and what stands for the design of a hybrid
    return f"{kind.title()}/{'DB' if kind == 'hybrid' else design}/{strategy}"


def with_owner(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunks with the owner of their document beside their own tenant, null for orphans."""
    owners = documents.select(F.col("id").alias("user_document_id"), F.col("user_id").alias("owner"))
    side = F.broadcast(owners) if fits_broadcast(owners, fusion.OWNER_ROWS, fusion.OWNER_BYTES) else owners
    return chunks.join(side, "user_document_id", "left")


def run_matrix(
    queries: DataFrame, corpus: Corpus, json_filter: dict | None, doc_filter: dict | None = None, k: int = LIMIT
) -> DataFrame:
    """Expected-answer ranks of every configuration, labelled `config, search_type, filter_strategy, schema_design`.

    One scan of the vectors and one of the text index answer all configurations; the normalised designs take the owner from one join.
    """
    rows = matrix(json_filter is not None)
    owned_ = replace(
        corpus, text=with_owner(corpus.text, corpus.documents), vectors=with_owner(corpus.vectors, corpus.documents), postings=None
    )
    near, found = _answers(queries, owned_, *matrix_settings(rows, json_filter, k))
    n_pool = queries.count() * min(k, fusion.MAX_RESULTS) * fusion.POOL_FACTOR
    results = []
    for kind, strategy, design in rows:
        label = config_label(kind, strategy, design)
        if kind == "hybrid":
            kept = doc_filter if strategy == "composite" else None
            legs = [fusion.keep_documents(_of(leg, label), corpus.documents, kept, n_pool) for leg in (found, near)]
            scored = fusion.rrf_scores(fusion.fuse(*legs), fusion.RRF_K)
            ranked = top_k_per_query(scored, "score", min(k, fusion.MAX_RESULTS), descending=True)
        else:
            ranked = _of(near if kind == "vector" else found, label)
        results.append(ranked.select(F.lit(label).alias("label"), "query_id", "id", "rank"))
    ranks = metrics.labelled_ranks(queries, _union(results), [config_label(*r) for r in rows])
    names = {config_label(*r): r for r in rows}
    parts = [F.create_map(*[F.lit(x) for label, r in names.items() for x in (label, r[i])]) for i in range(3)]
    return ranks.select(
        F.col("label").alias("config"),
        parts[0][F.col("label")].alias("search_type"),
        parts[1][F.col("label")].alias("filter_strategy"),
        parts[2][F.col("label")].alias("schema_design"),
        "query_id",
        "result_count",
        "found_ground_truth",
        "ground_truth_rank",
    )


def _union(parts) -> DataFrame:
    result = None
    for part in parts:
        result = part if result is None else result.unionByName(part)
    return result
