"""SQL counterparts of the registered queries, for a single-node SQL engine over the same tables.

They are written independently of the Spark code: text matching goes through a positions table, covers through as-of joins.
"""

from __future__ import annotations

TOKEN = r"'[\p{L}\p{N}]+'"

USERS = "users AS (SELECT DISTINCT 1 + doc_id % 20 AS id FROM documents)"

DOCS = r"""
d AS (
  SELECT s.doc_id AS id, 1 + s.doc_id % 20 AS user_id, s.doc_id AS wiki_id,
         'https://example.org/' || s.doc_id AS url,
         split_part(s.text, chr(10), 1) AS title,
         CAST(s.n_chars AS DOUBLE) AS views, 1 AS langs, s.lang AS language, s.source, l.quality
  FROM documents s LEFT JOIN labels l ON l.doc_id = s.doc_id
)"""

CHUNKS = r"""
c0 AS MATERIALIZED (
  SELECT doc_id, lang, len(lines) AS total_chunks, unnest(lines) AS text, unnest(range(len(lines))) AS paragraph_id
  FROM (SELECT doc_id, lang, string_split(text, chr(10)) AS lines FROM documents)
),
c AS MATERIALIZED (
  SELECT doc_id * 134217728 + paragraph_id AS id, doc_id AS user_document_id, 1 + doc_id % 20 AS user_id,
         paragraph_id, total_chunks, text, lang AS language_detected,
         1.0::DOUBLE + ((doc_id * 134217728 + paragraph_id) % 91 * 7919 % 91)::DOUBLE / 10.0::DOUBLE AS complexity_score,
         TIMESTAMP '2023-07-01 00:00:00' + to_days(((doc_id * 134217728 + paragraph_id) % 730)::INTEGER) AS created_at,
         len(regexp_extract_all(text, '\S+')) AS word_count,
         length(text) AS char_count,
         len(regexp_extract_all(text, '[.!?]')) AS sentence_count,
         CASE WHEN paragraph_id = 0 THEN 'beginning' WHEN paragraph_id >= total_chunks - 2 THEN 'end' ELSE 'middle' END
           AS position,
         CASE WHEN paragraph_id = 0 THEN 'introduction' END AS section_type,
         contains(text, '```') OR contains(text, 'def ') OR contains(text, 'function') OR contains(text, 'class ')
           OR contains(text, 'import ') AS has_code,
         contains(text, '=') OR contains(text, '+') OR contains(text, '-') OR contains(text, '*') OR contains(text, '/')
           OR contains(text, 'equation') OR contains(text, 'formula') AS has_math,
         contains(text, '•') OR contains(text, '1.') OR contains(text, '2.') OR contains(text, '- ')
           OR contains(text, '* ') AS has_list,
         length(text) - length(replace(text, '|', '')) > 4 AS has_table
  FROM c0
)"""

VECTORS = r"""
e AS MATERIALIZED (
  SELECT c.*, CAST(m.embedding AS DOUBLE[]) AS embedding
  FROM c JOIN embeddings m ON m.vec_id = c.user_document_id AND c.paragraph_id = 0
)"""

QUERIES = r"""
q AS MATERIALIZED (
  SELECT id AS query_id, user_id, embedding AS query_embedding, id AS ground_truth_chunk_id, user_document_id, meta_position,
         has_code, complexity_score,
         array_to_string(regexp_extract_all(
           CASE WHEN length(stripped) > 20 THEN stripped ELSE text END, '\S+')[1:10], ' ') AS query_text
  FROM (SELECT *, position AS meta_position, regexp_replace(text, '^\s+|\s+$', '', 'g') AS stripped FROM e)
)"""

POSITIONS = rf"""
v AS MATERIALIZED (
  SELECT id, user_id, unnest(words) AS lexeme, unnest(range(1, len(words) + 1)) AS pos
  FROM (SELECT id, user_id, regexp_extract_all(lower(text), {TOKEN}) AS words FROM c)
)"""


def base(*parts: str) -> str:
    return "WITH " + ",\n".join(parts)


def compiled(queries: str = "q") -> str:
    """Words of every query item: `qw(query_id, grp, item, neg, lex, off, words)`; equal items of a group count once."""
    return rf"""
qi AS (
  SELECT query_id, n, txt, count(*) FILTER (WHERE lower(txt) = 'or') OVER (PARTITION BY query_id ORDER BY n) AS grp
  FROM (
    SELECT query_id, unnest(items) AS txt, unnest(range(len(items))) AS n
    FROM (SELECT query_id, regexp_extract_all(coalesce(query_text, ''), '-?"[^"]*"|[^\s"]+') AS items FROM {queries})
  )
),
qd AS (
  SELECT query_id, grp, neg, words, row_number() OVER (PARTITION BY query_id ORDER BY grp, neg, words) AS item
  FROM (
    SELECT DISTINCT query_id, grp, starts_with(txt, '-') AS neg, regexp_extract_all(lower(txt), {TOKEN}) AS words
    FROM qi WHERE lower(txt) <> 'or'
  ) WHERE len(words) > 0
),
qw AS MATERIALIZED (
  SELECT query_id, grp, item, neg, len(words) AS words, unnest(words) AS lex, unnest(range(len(words))) AS off FROM qd
)"""


def matching(scoped: bool = True, queries: str = "q", chunks: str = "c") -> str:
    """`hit(query_id, id, grp)`: satisfied groups; `inst`: places of the required items in them; `rel`: relevance."""
    tenant = "AND v.user_id = k.user_id" if scoped else ""
    everywhere = f"{chunks}.user_id = k.user_id" if scoped else "TRUE"
    return rf"""
allowed AS (SELECT id FROM {chunks}),
places AS MATERIALIZED (
  SELECT w.query_id, w.grp, w.item, w.neg, v.id, v.pos - w.off AS s, v.pos - w.off + any_value(w.words) - 1 AS e
  FROM qw w JOIN {queries} k ON k.query_id = w.query_id JOIN v ON v.lexeme = w.lex {tenant}
  WHERE v.id IN (SELECT id FROM allowed)
  GROUP BY w.query_id, w.grp, w.item, w.neg, v.id, v.pos - w.off, w.words, v.pos - w.off + w.words - 1
  HAVING count(*) = w.words
),
needs AS (
  SELECT query_id, grp, count(DISTINCT item) FILTER (WHERE NOT neg) AS n_must FROM qw GROUP BY query_id, grp
),
offered AS (
  SELECT query_id, grp, id, count(DISTINCT item) FILTER (WHERE NOT neg) AS n_must, bool_or(neg) AS blocked
  FROM places GROUP BY query_id, grp, id
),
hit AS MATERIALIZED (
  SELECT o.query_id, o.grp, o.id FROM offered o JOIN needs n USING (query_id, grp)
  WHERE n.n_must > 0 AND o.n_must = n.n_must AND NOT coalesce(o.blocked, FALSE)
  UNION ALL
  SELECT n.query_id, n.grp, {chunks}.id
  FROM needs n JOIN {queries} k ON k.query_id = n.query_id JOIN {chunks} ON {everywhere}
  WHERE n.n_must = 0
    AND NOT EXISTS (SELECT 1 FROM places p WHERE p.query_id = n.query_id AND p.grp = n.grp AND p.id = {chunks}.id)
),
inst AS MATERIALIZED (
  SELECT p.query_id, p.id, p.grp, p.item, p.s, p.e FROM places p JOIN hit USING (query_id, grp, id) WHERE NOT p.neg
),
ends AS (SELECT DISTINCT query_id, id, e FROM inst),
asked AS (SELECT DISTINCT query_id, id, grp, item FROM inst),
latest AS (
  SELECT t.query_id, t.id, t.grp, t.item, t.e, i.s
  FROM (SELECT * FROM ends JOIN asked USING (query_id, id)) t
  ASOF JOIN inst i
    ON t.query_id = i.query_id AND t.id = i.id AND t.grp = i.grp AND t.item = i.item AND t.e >= i.e
),
reach AS (
  SELECT l.query_id, l.id, l.grp, l.e, min(l.s) AS b
  FROM latest l JOIN needs n USING (query_id, grp)
  GROUP BY l.query_id, l.id, l.grp, l.e, n.n_must HAVING count(*) = n.n_must
),
covers AS MATERIALIZED (
  SELECT query_id, id, b, min(e) AS e
  FROM (SELECT query_id, id, e, max(b) AS b FROM reach GROUP BY query_id, id, e)
  GROUP BY query_id, id, b
),
words AS (SELECT DISTINCT query_id, lex FROM qw WHERE NOT neg),
spots AS (
  SELECT DISTINCT w.query_id, v.id, v.pos
  FROM words w JOIN v ON v.lexeme = w.lex SEMI JOIN covers z ON z.query_id = w.query_id AND z.id = v.id
),
inside AS (
  SELECT z.query_id, z.id, z.b, z.e, count(*) AS n
  FROM covers z JOIN spots p ON p.query_id = z.query_id AND p.id = z.id AND p.pos BETWEEN z.b AND z.e
  GROUP BY z.query_id, z.id, z.b, z.e
),
density AS (
  SELECT query_id, id, sum(0.1::DOUBLE / (1 + (e - b) - (n - 1))) AS relevance FROM inside GROUP BY query_id, id
),
rel AS MATERIALIZED (
  SELECT h.query_id, h.id, coalesce(x.relevance, 0.0::DOUBLE) AS relevance
  FROM (SELECT DISTINCT query_id, id FROM hit) h LEFT JOIN density x USING (query_id, id)
)"""


# relevance sums differ in the last bits between engines; ties must not depend on them
TEXT_ORDER = "round(relevance, 9) DESC, id"


def text_pool(k: int, name: str = "tp") -> str:
    return f"""
{name} AS (
  SELECT query_id, id, relevance, rank FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {TEXT_ORDER}) AS rank FROM rel
  ) WHERE rank <= {k}
)"""


def vector_pool(
    k: int, scoped: bool = True, condition: str = "TRUE", name: str = "vp", chunks: str = "e", queries: str = "q"
) -> str:
    tenant = f"{chunks}.user_id = {queries}.user_id" if scoped else "TRUE"
    return f"""
{name} AS MATERIALIZED (
  SELECT query_id, id, distance, rank FROM (
    SELECT query_id, id, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM (
      SELECT {queries}.query_id, {chunks}.id,
             -list_inner_product({chunks}.embedding, {queries}.query_embedding) AS distance
      FROM {queries} JOIN {chunks} ON {tenant} AND ({condition})
    )
  ) WHERE rank <= {k}
)"""


def documents_kept(pool: str, condition: str, order: str) -> str:
    return f"""
{pool}f AS (
  SELECT p.* EXCLUDE (rank), row_number() OVER (PARTITION BY query_id ORDER BY p.rank) AS rank
  FROM {pool} p JOIN c ON c.id = p.id JOIN d ON d.id = c.user_document_id WHERE {condition}
)"""


def fused(k: int, text: str = "tp", vector: str = "vp", tw: str = "1.0", vw: str = "1.0", limit: int = 10) -> str:
    return f"""
f AS (
  SELECT query_id, id, t.rank AS text_rank, w.rank AS vector_rank, t.relevance, w.distance,
         coalesce(1.0::DOUBLE / ({k} + t.rank), 0) * {tw}::DOUBLE AS k_score,
         coalesce(1.0::DOUBLE / ({k} + w.rank), 0) * {vw}::DOUBLE AS v_score
  FROM {text} t FULL OUTER JOIN {vector} w USING (query_id, id)
),
r AS (
  SELECT * FROM (
    SELECT *, k_score + v_score AS score,
           row_number() OVER (PARTITION BY query_id ORDER BY k_score + v_score DESC, id) AS rank FROM f
  ) WHERE rank <= {limit}
)"""


SEARCH = (CHUNKS, VECTORS, QUERIES, POSITIONS, compiled())
R6 = "round({0}, 6) AS {0}"


def r6(*names: str) -> str:
    return ", ".join(R6.format(n) for n in names)


BENCH_QUERIES = r"""
bq AS MATERIALIZED (
  SELECT item_id AS query_id, 1 + item_id % 20 AS user_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark
)"""

SHORT_QUERIES = """
q AS (
  SELECT * FROM (VALUES (1, 'the'), (2, 'of'), (3, 'and'), (4, 'de'), (5, 'la'), (6, 'the and'), (7, '  '), (8, 'zzzz'))
    AS t(query_id, query_text)
)"""

RUNS = r"""
runs AS MATERIALIZED (
  SELECT event_type AS search_type, CASE WHEN user_id % 2 = 0 THEN 'user_only' ELSE 'no_filter' END AS filter_type,
         value AS latency_ms, nullif(CAST(props ->> '$.k' AS BIGINT) % 16, 0) AS ground_truth_rank,
         CASE WHEN event_id % 3 = 0 THEN 'vector' WHEN event_id % 3 = 1 THEN 'text' ELSE 'hybrid' END AS kind,
         CASE event_type WHEN 'view' THEN 'no_filter' WHEN 'click' THEN 'user_id' WHEN 'purchase' THEN 'jsonb'
           ELSE 'composite' END AS filter_strategy,
         CASE WHEN user_id % 2 = 0 THEN 'denorm' ELSE 'join' END AS schema_design, event_id, ts
  FROM events
),
stats AS MATERIALIZED (
  SELECT kind || '/' || schema_design || '/' || filter_strategy AS config, kind AS search_type, filter_strategy,
         schema_design, avg(latency_ms) AS avg_ms, 1000 / avg(latency_ms) AS qps
  FROM runs GROUP BY kind, filter_strategy, schema_design
)"""

PERCENTILES = """
       sort_list[greatest(1, CAST(floor(n * 0.95::DOUBLE) AS BIGINT))] AS p95_ms,
       CASE WHEN n >= 100 THEN sort_list[CAST(floor(n * 0.99::DOUBLE) AS BIGINT)] ELSE sort_list[n] END AS p99_ms"""


# every pair of a query and an embedded chunk, and every match, with what settings are decided by
PAIRS = r"""
vd AS MATERIALIZED (
  SELECT q.query_id, q.user_id AS asker, q.meta_position AS asked_position, q.has_code AS asked_code,
         q.complexity_score AS asked_score, e.* EXCLUDE (embedding),
         -list_inner_product(e.embedding, q.query_embedding) AS distance
  FROM q CROSS JOIN e
),
td AS MATERIALIZED (
  SELECT rel.query_id, rel.relevance, q.user_id AS asker, c.*
  FROM rel JOIN q ON q.query_id = rel.query_id JOIN c ON c.id = rel.id
)"""


def leg(kind: str, k: int, condition: str = "TRUE") -> str:
    """Best k of each query under a condition: `query_id, id, rank`."""
    order, table = ("distance, id", "vd") if kind == "vector" else (TEXT_ORDER, "td")
    return f"""SELECT * FROM (
        SELECT query_id, id, user_document_id, row_number() OVER (PARTITION BY query_id ORDER BY {order}) AS rank
        FROM {table} WHERE {condition}
      ) WHERE rank <= {k}"""


def both_legs(text: str, vector: str, score: str) -> str:
    """Ten best by the score of a text rank t and a vector rank w."""
    return f"""SELECT * FROM (
        SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY {score} DESC, id) AS rank FROM (
          SELECT query_id, id, x.rank AS t, y.rank AS w FROM ({text}) x FULL OUTER JOIN ({vector}) y USING (query_id, id)
        )
      ) WHERE rank <= 10"""


def in_documents(pool: str, condition: str) -> str:
    return f"""SELECT query_id, p.id, p.user_document_id, row_number() OVER (PARTITION BY query_id ORDER BY p.rank) AS rank
      FROM ({pool}) p JOIN d ON d.id = p.user_document_id WHERE {condition}"""


def evaluated(searches: dict[tuple, str], names: tuple[str, ...]) -> str:
    """How often and how high each search finds the expected chunk."""
    labels = ", ".join(names)

    def label(key: tuple) -> str:
        return ", ".join(f"'{x}' AS {n}" for x, n in zip(key, names, strict=True))

    results = " UNION ALL ".join(f"SELECT {label(key)}, query_id, id, rank FROM ({sql})" for key, sql in searches.items())
    every = " UNION ALL ".join(f"SELECT {label(key)}" for key in searches)
    cuts = ", ".join(f"round(avg(CASE WHEN g <= {k} THEN 1.0::DOUBLE ELSE 0 END), 6) AS recall_at_{k}" for k in (1, 5, 10))
    return f"""
SELECT {labels}, {cuts}, round(avg(coalesce(1.0::DOUBLE / g, 0)), 6) AS mrr, round(avg(g), 6) AS avg_rank, count(g) AS found,
       count(*) AS total_queries
FROM (
  SELECT {labels}, q.query_id, min(r.rank) FILTER (WHERE r.id = q.ground_truth_chunk_id) AS g
  FROM ({every}) CROSS JOIN q LEFT JOIN ({results}) r USING ({labels}, query_id) GROUP BY {labels}, q.query_id
) GROUP BY {labels}"""


def suite_searches() -> dict[tuple, str]:
    own = "user_id = asker"
    position = "position = coalesce(asked_position, 'middle') AND has_code = coalesce(asked_code, false)"
    score = "complexity_score BETWEEN greatest(0, coalesce(asked_score, 5.0) - 2) AND coalesce(asked_score, 5.0) + 2"
    rrf = "coalesce(1.0::DOUBLE / (50 + t), 0) + coalesce(1.0::DOUBLE / (50 + w), 0)"
    two = "1.0::DOUBLE / (60 + coalesce(w, 1000)) + 1.0::DOUBLE / (60 + coalesce(t, 1000))"
    return {
        ("vector", "no_filter"): leg("vector", 10),
        ("vector", "user_only"): leg("vector", 10, own),
        ("vector", "user_jsonb"): leg("vector", 10, f"{own} AND {position}"),
        ("vector", "user_jsonb_complex"): leg("vector", 10, f"{own} AND language_detected = 'en' AND {score}"),
        ("text", "no_filter"): leg("text", 10),
        ("text", "user_only"): leg("text", 10, own),
        ("hybrid", "user_only"): both_legs(leg("text", 20, own), leg("vector", 20, own), rrf),
        ("hybrid_two_queries", "user_only"): both_legs(leg("text", 40, own), leg("vector", 40, own), two),
    }


def matrix_searches() -> dict[tuple, str]:
    own, narrow = "user_id = asker", "position = 'beginning' AND NOT has_math"
    owner = "(SELECT d.user_id FROM d WHERE d.id = user_document_id)"
    strategies = {
        "denorm": {"no_filter": "TRUE", "user_id": own, "jsonb": narrow, "composite": f"{own} AND created_at > TIMESTAMP '2024-01-01'"},
        "join": {"no_filter": f"{owner} IS NOT NULL", "user_id": f"{owner} = asker", "jsonb": f"{owner} IS NOT NULL AND {narrow}"},
    }
    found = {
        (f"{kind.title()}/{design}/{strategy}",): leg(kind, 10, condition)
        for kind in ("vector", "text")
        for design, conditions in strategies.items()
        for strategy, condition in conditions.items()
    }
    rrf = "coalesce(1.0::DOUBLE / (50 + t), 0) + coalesce(1.0::DOUBLE / (50 + w), 0)"
    pools = {c: [leg(kind, 20, c) for kind in ("text", "vector")] for c in (own, f"{own} AND {narrow}")}
    found["Hybrid/DB/user_id",] = both_legs(*pools[own], rrf)
    found["Hybrid/DB/jsonb",] = both_legs(*pools[f"{own} AND {narrow}"], rrf)
    english = [in_documents(p, "d.language = 'en'") for p in pools[f"{own} AND {narrow}"]]
    found["Hybrid/DB/composite",] = both_legs(*english, rrf)
    return found


def statements() -> dict[str, str]:
    sql: dict[str, str] = {}
    sql["suite_quality"] = base(*SEARCH, matching(scoped=False), PAIRS) + evaluated(suite_searches(), ("search_type", "filter_type"))
    sql["matrix_quality"] = base(DOCS, *SEARCH, matching(scoped=False), PAIRS) + evaluated(matrix_searches(), ("config",))

    # ---- ingestion and features
    sql["feature_chunk_stats"] = base(CHUNKS) + "SELECT id, word_count, char_count, sentence_count FROM c"
    sql["chunk_position_flags"] = base(CHUNKS) + (
        "SELECT id, position, section_type, has_code, has_math, has_list, has_table FROM c"
    )
    grouped = r"""
SELECT url, d.title, d.wiki_id, d.views, d.langs, n_chunks, words AS word_count
FROM d JOIN (SELECT user_document_id, count(*) AS n_chunks, CAST(sum(word_count) AS BIGINT) AS words FROM c GROUP BY 1) x
  ON x.user_document_id = d.id"""
    sql["group_documents"] = base(DOCS, CHUNKS) + grouped
    sql["chunk_ordinals"] = base(CHUNKS) + (
        "SELECT id, paragraph_id AS chunk_index, total_chunks FROM c"
    )
    sql["assign_users_even"] = base(USERS, DOCS) + r""",
size AS (SELECT (SELECT count(*) FROM d) AS n, (SELECT count(*) FROM users) AS u),
quota AS (
  SELECT id, least(n // u + CASE WHEN row_number() OVER (ORDER BY id) <= n % u THEN 1 ELSE 0 END, 30) AS share FROM users, size
),
bounds AS (SELECT id, sum(share) OVER (ORDER BY id) - share AS lo, sum(share) OVER (ORDER BY id) AS hi FROM quota),
placed AS (SELECT url, row_number() OVER (ORDER BY wiki_id) - 1 AS place FROM d)
SELECT p.url, b.id AS user_id FROM placed p JOIN bounds b ON p.place >= b.lo AND p.place < b.hi"""
    sql["assign_users_shuffled"] = base(USERS, DOCS) + r""",
size AS (SELECT (SELECT count(*) FROM d) AS n, (SELECT count(*) FROM users) AS u)
SELECT id AS user_id,
       CAST(least(n // u + CASE WHEN row_number() OVER (ORDER BY id) <= n % u THEN 1 ELSE 0 END, 30) AS BIGINT) AS n_documents
FROM users, size"""
    sql["denormalised_chunks"] = base(CHUNKS) + "SELECT user_id, count(*) AS n_chunks FROM c GROUP BY user_id"
    sql["ingest_stats"] = base(USERS, CHUNKS) + r"""
SELECT (SELECT count(*) FROM users) AS total_users, (SELECT count(*) FROM documents) AS total_documents,
       (SELECT count(*) FROM c) AS total_chunks,
       (SELECT count(*) FROM documents)::DOUBLE / (SELECT count(*) FROM users) AS avg_docs_per_user"""
    sql["head_slice"] = base(CHUNKS) + "SELECT id, paragraph_id, text FROM c ORDER BY id LIMIT 500"
    sql["embed_batch"] = r"""
SELECT doc_id, length(text)::DOUBLE AS x0, len(regexp_extract_all(text, 'e'))::DOUBLE AS x1 FROM documents"""
    sql["embed_ledger_runs"] = r"""
SELECT doc_id, length(text)::DOUBLE AS x0, len(regexp_extract_all(text, 'e'))::DOUBLE AS x1,
       (SELECT count(DISTINCT text) FROM documents) AS texts, 0 AS again FROM documents"""
    sql["stream_ingest"] = base(CHUNKS) + "SELECT user_document_id, paragraph_id, user_id, word_count, position FROM c"

    # ---- data quality
    sql["unique_violations"] = "SELECT md5(text) AS text_md5, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1"
    sql["unique_chunk_keys"] = base(CHUNKS) + (
        "SELECT user_document_id, paragraph_id, count(*) AS n FROM c GROUP BY 1, 2 HAVING count(*) > 1"
    )
    sql["orphan_rows"] = base(USERS) + "SELECT event_id, user_id FROM events WHERE user_id NOT IN (SELECT id FROM users)"
    sql["vectors_without_text"] = """
SELECT m.vec_id, m.label, len(m.embedding) AS dimensions,
       CASE WHEN EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = m.vec_id) THEN 'no text' ELSE 'no document' END AS reason
FROM embeddings m WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = m.vec_id AND d.text IS NOT NULL)"""
    sql["cascade_delete"] = base(CHUNKS) + r""",
english AS (SELECT 1 + doc_id % 20 AS user_id, count(*) FILTER (WHERE lang = 'en') AS n FROM documents GROUP BY 1),
gone AS (SELECT user_id FROM english WHERE n < (SELECT avg(n) FROM english))
SELECT id, user_id FROM c WHERE user_id NOT IN (SELECT user_id FROM gone)"""
    sql["rule_validation"] = base(CHUNKS) + r"""
SELECT id, array_to_string(list_filter([
  CASE WHEN section_type IS NULL THEN 'section_type missing' END,
  CASE WHEN word_count < 5 THEN 'word_count out of range' END,
  CASE WHEN sentence_count < 1 THEN 'sentence_count out of range' END,
  CASE WHEN complexity_score > 9 THEN 'complexity_score out of range' END], lambda x: x IS NOT NULL), ';') AS reasons
FROM c WHERE section_type IS NULL OR word_count < 5 OR sentence_count < 1 OR complexity_score > 9"""
    sql["request_validation"] = r"""
SELECT conv_id, turn, array_to_string(list_filter([
  CASE WHEN turn * 25 NOT BETWEEN 1 AND 100 THEN 'limit out of range' END,
  CASE WHEN conv_id % 21 = 0 THEN 'user_id missing' END,
  CASE WHEN role <> 'user' THEN 'embedding missing' END], lambda x: x IS NOT NULL), ';') AS reasons
FROM conversations WHERE turn * 25 NOT BETWEEN 1 AND 100 OR conv_id % 21 = 0 OR role <> 'user'"""

    # ---- predicates and projections
    sql["json_eq_bool_range"] = base(CHUNKS) + r"""
SELECT id FROM c WHERE position = 'middle' AND has_math AND complexity_score BETWEEN 3.0 AND 7.0 AND language_detected = 'en'"""
    sql["json_key_exists"] = base(CHUNKS) + "SELECT id FROM c WHERE section_type IS NOT NULL"
    sql["json_contains"] = base(CHUNKS) + "SELECT id FROM c WHERE position = 'end' AND has_list"
    sql["json_postings_contains"] = sql["json_contains"]
    sql["json_postings_key"] = sql["json_key_exists"]
    nested = {
        "object": "n_chars > 1000",
        "array": "list_has_all([lang, source], ['src2', 'de'])",
        "both": "lang = 'en' AND NOT n_chars > 1000",
        "element": "(doc_id % 3 = 1 AND lang = 'fr') OR (doc_id % 5 = 1 AND source = 'fr')",
        "elements": "(lang = 'es' OR source = 'es') AND (doc_id % 3 = 2 OR doc_id % 5 = 2)",
        "anything": "true",
        "nothing": "false",
    }
    sql["json_postings_nested"] = " UNION ALL ".join(
        f"SELECT '{name}' AS filter, doc_id AS id FROM documents WHERE {condition}" for name, condition in nested.items()
    )
    sql["json_contains_number"] = "SELECT event_id FROM events WHERE json_contains(props, '{\"k\": 69}')"
    sql["date_and_length_filter"] = base(CHUNKS) + (
        "SELECT id FROM c WHERE created_at > TIMESTAMP '2024-01-01' AND length(text) > 300"
    )
    sql["metadata_defaults"] = base(DOCS) + "SELECT id, coalesce(quality, 5)::DOUBLE AS quality FROM d"
    sql["text_shapes"] = base(CHUNKS, VECTORS, QUERIES) + r"""
SELECT c.id, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS short,
       substr(text, 1, 200) || '...' AS preview, strftime(created_at, '%Y-%m-%dT%H:%M:%S') AS created,
       array_to_string(regexp_extract_all(CASE WHEN length(stripped) > 20 THEN stripped ELSE text END, '\S+')[1:10], ' ')
         AS query_text
FROM (SELECT *, regexp_replace(text, '^\s+|\s+$', '', 'g') AS stripped FROM c) c"""
    sql["vector_literals"] = r"""
SELECT vec_id, len(embedding)::INTEGER AS n, round(list_sum(CAST(embedding AS DOUBLE[])), 5) AS total FROM embeddings"""

    # ---- histograms
    sql["json_key_histogram"] = base(CHUNKS) + r""",
present AS (
  SELECT unnest(CASE WHEN section_type IS NULL THEN k ELSE list_append(k, 'section_type') END) AS key
  FROM c, (SELECT ['position', 'word_count', 'char_count', 'sentence_count', 'has_code', 'has_math', 'has_list', 'has_table',
                   'language_detected', 'complexity_score'] AS k)
)
SELECT key, count(*) AS count FROM present GROUP BY key ORDER BY count DESC, key LIMIT 10"""
    sql["json_value_histogram"] = base(CHUNKS) + (
        "SELECT CAST(word_count AS VARCHAR) AS val, count(*) AS cnt FROM c GROUP BY 1 ORDER BY cnt DESC, val LIMIT 10"
    )
    sql["json_value_summary"] = sql["json_value_histogram"]
    sql["frequent_words"] = base(CHUNKS, POSITIONS) + (
        "SELECT lexeme AS val, count(*) AS cnt FROM v GROUP BY lexeme ORDER BY cnt DESC, val LIMIT 30"
    )
    sql["json_frequent_values"] = base(CHUNKS) + (
        "SELECT position AS val, count(*) AS cnt FROM c GROUP BY 1 HAVING count(*) > 100 ORDER BY cnt DESC, val LIMIT 5"
    )
    sql["json_distinct_keys"] = "SELECT unnest(['char_count', 'complexity_score', 'has_code', 'has_list', 'has_math']) AS key"
    sql["users_over_threshold"] = base(CHUNKS) + (
        "SELECT user_id, count(*) AS chunk_count FROM c GROUP BY user_id HAVING count(*) > 100"
    )

    # ---- semantic search
    one = "one AS (SELECT CAST(embedding AS DOUBLE[]) AS v, 1 + vec_id % 20 AS u FROM embeddings ORDER BY vec_id DESC LIMIT 1)"
    single = "round(-list_inner_product(embedding, v), 6) AS distance FROM e, one"
    near = "ORDER BY -list_inner_product(embedding, v), id LIMIT 10"
    sql["vector_topk"] = base(CHUNKS, VECTORS, one) + f"SELECT id, user_document_id, {single} {near}"
    sql["vector_user"] = base(CHUNKS, VECTORS, one) + (
        f"SELECT id, user_document_id, text, {single} WHERE user_id = u ORDER BY -list_inner_product(embedding, v), id LIMIT 40"
    )
    sql["vector_key_exists"] = base(CHUNKS, VECTORS, one) + (
        f"SELECT id, {single} WHERE section_type IS NOT NULL {near}"
    )
    ranked = "SELECT query_id, id, rank, round(distance, 6) AS distance FROM vp"

    def nearest(k: int = 10, extra: tuple = (), **how) -> str:
        return base(CHUNKS, VECTORS, QUERIES, *extra, vector_pool(k, **how)) + ranked

    sql["vector_batch_user"] = nearest()
    sql["vector_batch_all"] = nearest(scoped=False)
    sql["vector_batch_shuffled"] = sql["vector_batch_all"]
    sql["vector_user_shuffled"] = sql["vector_batch_user"]
    sql["vector_user_json"] = nearest(condition="e.position = q.meta_position AND e.has_code = q.has_code")
    sql["vector_user_json_range"] = nearest(
        condition="e.language_detected = 'en' AND e.complexity_score BETWEEN greatest(0, q.complexity_score - 2) "
        "AND q.complexity_score + 2"
    )
    sql["vector_contains"] = nearest(scoped=False, condition="e.position = 'beginning' AND NOT e.has_math")
    sql["vector_user_date"] = nearest(condition="e.created_at > TIMESTAMP '2024-01-01'")
    sql["vector_join_none"] = nearest(scoped=False)
    sql["vector_join_user"] = nearest()
    sql["vector_join_json"] = nearest(scoped=False, condition="e.position = 'beginning' AND NOT e.has_math")
    sql["ann_all_probes"] = nearest(scoped=False)
    sql["ann_codes_whole_pool"] = nearest(scoped=False)
    sql["ann_codes_recall"] = base(CHUNKS, VECTORS, QUERIES) + """
      SELECT count(*) AS queries, true AS recall_reached, 16 AS code_bytes, 4 * max(len(query_embedding)) AS vector_bytes FROM q"""
    sql["ann_recall_curve"] = "SELECT 5 AS efforts, true AS never_falls, 1.0 AS all_probes"
    sql["known_item_sample"] = base(CHUNKS) + r"""
, drawn AS (SELECT * FROM c WHERE CAST('0x' || substr(md5(id || ':2'), 1, 8) AS BIGINT) % 1000000 < 20000),
few AS (SELECT * FROM drawn ORDER BY md5(id || ':0'), id LIMIT 90),
chosen AS (SELECT *, regexp_replace(text, '^\s+|\s+$', '', 'g') AS stripped FROM few ORDER BY md5(id || ':1'), id LIMIT 30)
SELECT id, user_id, user_document_id, array_to_string(regexp_extract_all(
  CASE WHEN length(stripped) > 20 THEN stripped ELSE text END, '\S+')[1:10], ' ') AS search_text FROM chosen"""
    sql["block_sample_report"] = base(CHUNKS) + "SELECT true AS repeats, true AS inside, count(*) AS whole FROM c"
    sql["random_documents"] = base(CHUNKS) + """
, one AS (SELECT user_document_id, user_id, arg_min(id, md5(id || ':0')) AS chunk_id FROM c WHERE length(text) > 300 GROUP BY ALL)
SELECT user_document_id AS document_id, chunk_id, user_id FROM one
ORDER BY md5(user_document_id || ':1'), user_document_id LIMIT 50"""
    sql["sample_parameters"] = base(CHUNKS, VECTORS) + """
, u AS (SELECT user_id FROM c GROUP BY user_id HAVING count(*) > 100 ORDER BY md5(user_id || ':0'), user_id LIMIT 1)
SELECT user_id, (SELECT len(arg_min(embedding, id)) FROM e WHERE e.user_id = u.user_id) AS n,
  (SELECT arg_min(position, id) FROM c WHERE c.user_id = u.user_id) AS position FROM u"""
    sql["layout_manifest"] = base(CHUNKS) + "SELECT user_id, count(*) AS n_chunks FROM c GROUP BY user_id"

    # ---- keyword search
    sql["postings_simple"] = base(CHUNKS, POSITIONS) + (
        "SELECT lexeme, id, user_id, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) AS positions FROM v GROUP BY 1, 2, 3"
    )
    sql["vocabulary_simple"] = base(CHUNKS, POSITIONS) + (
        "SELECT lexeme, count(DISTINCT id) AS n_chunks FROM v GROUP BY lexeme"
    )
    found = f"SELECT query_id, id, rank, {r6('relevance')} FROM tp"

    def keyword(scoped: bool = True, condition: str | None = None, queries: str = QUERIES, k: int = 10) -> str:
        narrowed = [f"cf AS MATERIALIZED (SELECT * FROM c WHERE {condition})"] if condition else []
        return (
            base(CHUNKS, VECTORS, queries, POSITIONS, compiled(), *narrowed,
                 matching(scoped, chunks="cf" if condition else "c"), text_pool(k))
            + found
        )

    sql["keyword_user"] = keyword()
    sql["keyword_all"] = keyword(scoped=False)
    sql["keyword_vocabulary_anchor"] = keyword()
    sql["keyword_shuffle_join"] = keyword()
    sql["keyword_short"] = keyword(scoped=False, queries=SHORT_QUERIES, k=100)
    phrase = BENCH_QUERIES + r""",
q AS (SELECT query_id, user_id, '"' || w[1] || ' ' || w[2] || '" ' || w[3] AS query_text FROM bq)"""
    sql["keyword_phrase"] = keyword(scoped=False, queries=phrase)
    either = BENCH_QUERIES + r""",
q AS (SELECT query_id, user_id, w[1] || ' ' || w[2] || ' or "' || w[3] || ' ' || w[4] || '" -' || w[5] AS query_text FROM bq)"""
    sql["keyword_or_not"] = keyword(queries=either)
    negative = BENCH_QUERIES + r""",
q AS (SELECT query_id, user_id, '-' || w[1] || ' -"' || w[2] || ' ' || w[3] || '"' AS query_text FROM bq)"""
    sql["keyword_only_negative"] = keyword(queries=negative)
    sql["keyword_postings"] = sql["keyword_user"]
    sql["keyword_negative_postings"] = sql["keyword_only_negative"]
    sql["keyword_block_user"] = sql["keyword_user"]
    sql["keyword_block_short"] = sql["keyword_short"]
    sql["keyword_block_phrase"] = sql["keyword_phrase"]
    sql["keyword_block_or_not"] = sql["keyword_or_not"]
    sql["keyword_block_negative"] = sql["keyword_only_negative"]
    sql["keyword_blocks_read"] = base(CHUNKS, POSITIONS) + """
      SELECT lexeme, count(DISTINCT id) AS postings, true AS falls FROM v GROUP BY lexeme
      ORDER BY postings DESC, lexeme LIMIT 30"""
    sql["keyword_json"] = keyword(scoped=False, condition="position = 'beginning' AND NOT has_math")
    sql["keyword_user_date"] = keyword(condition="created_at > TIMESTAMP '2024-01-01'")
    sql["keyword_join_none"] = keyword(scoped=False)
    sql["keyword_join_user"] = keyword()
    sql["keyword_join_json"] = keyword(scoped=False, condition="position = 'beginning' AND NOT has_math")

    # ---- hybrid search
    payload = f"""
SELECT r.query_id, r.rank, r.id, c.user_document_id, c.paragraph_id, c.text, {r6('k_score', 'v_score', 'score')}
FROM r JOIN c ON c.id = r.id"""
    both = (text_pool(20), vector_pool(20))
    sql["hybrid_rrf"] = base(*SEARCH, matching(), *both, fused(50)) + payload
    sql["hybrid_layout"] = sql["hybrid_rrf"]
    sql["incremental_hybrid"] = sql["hybrid_rrf"]
    sql["incremental_vocabulary"] = sql["vocabulary_simple"]
    sql["incremental_blocks"] = sql["keyword_user"]
    narrowed = "cf AS MATERIALIZED (SELECT * FROM c WHERE position = 'beginning' AND NOT has_math)"
    narrow_pools = (
        narrowed, matching(chunks="cf"), text_pool(20), vector_pool(20, condition="e.position = 'beginning' AND NOT e.has_math")
    )
    ids = f"SELECT query_id, id, rank, {r6('k_score', 'v_score', 'score')} FROM r"
    sql["hybrid_chunk_filter"] = base(*SEARCH, *narrow_pools, fused(50)) + ids
    english = "d.language = 'en'"
    sql["hybrid_doc_filter"] = (
        base(DOCS, *SEARCH, *narrow_pools, documents_kept("tp", english, ""), documents_kept("vp", english, ""),
             fused(50, "tpf", "vpf")) + ids
    )
    sql["hybrid_capped"] = (
        base(*SEARCH, matching(), text_pool(60), vector_pool(60), fused(50, limit=30)) + ids
    )
    sql["hybrid_weights"] = (
        base(*SEARCH, matching(), *both)
        + r""",
s AS (
  SELECT * FROM (VALUES ('balanced', 1.0, 1.0), ('text_heavy', 2.0, 1.0), ('vector_heavy', 1.0, 2.0), ('text_only', 1.0, 0.0),
                        ('vector_only', 0.0, 1.0)) AS t(weights, tw, vw)
),
f AS (
  SELECT weights, query_id, id, coalesce(1.0::DOUBLE / (50 + t.rank), 0) * tw::DOUBLE AS k_score,
         coalesce(1.0::DOUBLE / (50 + w.rank), 0) * vw::DOUBLE AS v_score
  FROM (tp t FULL OUTER JOIN vp w USING (query_id, id)), s
),
r AS (
  SELECT * FROM (
    SELECT *, k_score + v_score AS score,
           row_number() OVER (PARTITION BY weights, query_id ORDER BY k_score + v_score DESC, id) AS rank FROM f
  ) WHERE rank <= 10
)
SELECT weights, query_id, id, rank, round(score, 6) AS score FROM r"""
    )
    sql["hybrid_two_query"] = (
        base(*SEARCH, matching(), text_pool(40), vector_pool(40))
        + r""",
f AS (
  SELECT query_id, id, t.rank AS text_rank, w.rank AS vector_rank,
         1.0::DOUBLE / (60 + coalesce(w.rank, 1000)) + 1.0::DOUBLE / (60 + coalesce(t.rank, 1000)) AS rrf_score
  FROM tp t FULL OUTER JOIN vp w USING (query_id, id)
)
SELECT query_id, id AS chunk_id, text_rank, vector_rank, round(rrf_score, 6) AS rrf_score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, id) AS rank FROM f
) WHERE rank <= 10"""
    )
    sql["hybrid_weighted_raw"] = (
        base(*SEARCH, matching(), text_pool(100), vector_pool(100))
        + r""",
f AS (
  SELECT query_id, id, coalesce(relevance, 0) AS k_score, coalesce(1.0::DOUBLE / (60 + w.rank), 0) AS v_score,
         coalesce(1.0::DOUBLE / (60 + w.rank), 0) * 1.0 + coalesce(1.0::DOUBLE / (60 + t.rank), 0) * 2.0 AS score
  FROM tp t FULL OUTER JOIN vp w USING (query_id, id)
)
SELECT query_id, id, round(k_score, 6) AS k_score, round(v_score, 6) AS v_score, round(score, 6) AS score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM f
) WHERE rank <= 10"""
    )
    plain = "SELECT query_id, id, rank, round(score, 6) AS score FROM r"
    sql["hybrid_plain_user"] = base(*SEARCH, matching(), text_pool(40), vector_pool(40), fused(50)) + plain
    sql["hybrid_plain_join"] = sql["hybrid_plain_user"]
    sql["hybrid_plain_none"] = (
        base(*SEARCH, matching(False), text_pool(40), vector_pool(40, scoped=False), fused(50)) + plain
    )

    # ---- results, parents, responses
    hybrid = base(DOCS, *SEARCH, matching(), *both, fused(50))
    sql["parent_fetch"] = hybrid + r"""
SELECT DISTINCT d.id, d.user_id, d.title, d.url FROM r JOIN c ON c.id = r.id JOIN q ON q.query_id = r.query_id
JOIN d ON d.id = c.user_document_id AND d.user_id = q.user_id"""
    sql["enriched_results"] = hybrid + r"""
SELECT r.query_id, r.rank, r.id AS chunk_id, round(r.score, 6) AS score, d.title AS document_title, d.url AS document_url
FROM r JOIN c ON c.id = r.id JOIN q ON q.query_id = r.query_id
LEFT JOIN d ON d.id = c.user_document_id AND d.user_id = q.user_id"""
    sql["first_document_ranks"] = hybrid + r"""
SELECT r.query_id, c.user_document_id AS document_id, min(r.rank) AS first_rank FROM r JOIN c ON c.id = r.id GROUP BY 1, 2"""
    sql["ground_truth_rank"] = hybrid + r"""
SELECT q.query_id, g.rank AS ground_truth_rank, g.rank IS NOT NULL AS found_ground_truth,
       (SELECT count(*) FROM r x WHERE x.query_id = q.query_id) AS result_count
FROM q LEFT JOIN r g ON g.query_id = q.query_id AND g.id = q.ground_truth_chunk_id"""
    routed = r""",
kind AS (
  SELECT query_id, CASE user_document_id % 3 WHEN 0 THEN 'semantic' WHEN 1 THEN 'keyword' ELSE 'hybrid' END AS search_type,
         1 + user_document_id % 12 AS lim FROM q
),
legs AS (
  SELECT query_id, id, rank, 1.0::DOUBLE / rank AS score, 'semantic' AS search_type FROM vp100
  UNION ALL SELECT query_id, id, rank, 1.0::DOUBLE / rank, 'keyword' FROM tp100
),
pools AS (
  SELECT k.query_id, k.lim, least(k.lim, 30) * 2 AS pool_k FROM kind k WHERE search_type = 'hybrid'
),
hf AS (
  SELECT query_id, id, coalesce(1.0::DOUBLE / (50 + t.rank), 0) + coalesce(1.0::DOUBLE / (50 + w.rank), 0) AS score
  FROM (SELECT p.* FROM tp100 p JOIN pools USING (query_id) WHERE rank <= pool_k) t
  FULL OUTER JOIN (SELECT p.* FROM vp100 p JOIN pools USING (query_id) WHERE rank <= pool_k) w USING (query_id, id)
),
hr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM hf),
results AS (
  SELECT l.query_id, l.id, l.rank, l.score, k.search_type FROM legs l JOIN kind k USING (query_id, search_type) WHERE rank <= lim
  UNION ALL SELECT h.query_id, h.id, h.rank, h.score, 'hybrid' FROM hr h JOIN kind k USING (query_id) WHERE rank <= lim
)"""
    pools100 = base(*SEARCH, matching(), text_pool(100, "tp100"), vector_pool(100, name="vp100")) + routed
    sql["search_results"] = pools100 + r"""
SELECT s.query_id, s.search_type, s.rank, s.id AS chunk_id, c.user_document_id AS document_id,
       CASE WHEN length(c.text) > 200 THEN substr(c.text, 1, 200) || '...' ELSE c.text END AS text, round(s.score, 6) AS score
FROM results s JOIN c ON c.id = s.id"""
    sql["search_response"] = pools100 + r"""
SELECT k.query_id, k.search_type, q.query_text, count(s.id) AS total_results,
       string_agg(CAST(s.id AS VARCHAR), ',' ORDER BY s.rank) AS chunk_ids
FROM kind k JOIN q USING (query_id) LEFT JOIN results s USING (query_id) GROUP BY 1, 2, 3"""

    # ---- evaluation sets
    sql["known_item_set"] = base(CHUNKS, VECTORS, QUERIES) + "SELECT query_id AS id, user_id, query_text AS search_text FROM q"
    sql["one_chunk_per_doc"] = base(DOCS, CHUNKS) + r"""
SELECT d.id AS document_id, d.title AS document_title, d.user_id, x.id AS chunk_id, c.paragraph_id
FROM (SELECT user_document_id, min(id) AS id FROM c WHERE length(text) > 300 GROUP BY 1) x
JOIN c ON c.id = x.id JOIN d ON d.id = x.user_document_id"""
    sql["attach_queries"] = base(DOCS, CHUNKS) + r""",
picked AS (
  SELECT d.id AS document_id, d.title, d.user_id, x.id AS chunk_id, row_number() OVER (ORDER BY d.id) - 1 AS place
  FROM (SELECT user_document_id, min(id) AS id FROM c WHERE length(text) > 300 GROUP BY 1) x JOIN d ON d.id = x.user_document_id
),
texts AS (
  SELECT conv_id AS batch, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS j, text FROM conversations
)
SELECT row_number() OVER (ORDER BY t.batch, t.j) AS query_id, t.text AS query_text, p.chunk_id AS ground_truth_chunk_id,
       p.document_id AS ground_truth_document_id, p.title AS document_title,
       substr(c.text, 1, 200) || '...' AS chunk_text_preview
FROM texts t JOIN picked p ON p.place // 10 = t.batch AND p.place % 10 = t.j // 2 JOIN c ON c.id = p.chunk_id"""
    sql["evaluation_files"] = base(CHUNKS, VECTORS, QUERIES) + r"""
SELECT query_id, query_text, ground_truth_chunk_id, user_id AS ground_truth_user_id, meta_position AS position,
       round(list_sum(query_embedding), 4) AS vector_sum FROM q"""
    sql["evaluation_tenants"] = base(CHUNKS, VECTORS, QUERIES) + "SELECT DISTINCT user_id AS ground_truth_user_id FROM q"

    # ---- metrics
    sql["run_metrics"] = base(RUNS) + r"""
SELECT search_type, filter_type, round(avg(latency_ms), 6) AS mean, round(median(latency_ms), 6) AS median,
       round(coalesce(stddev_samp(latency_ms), 0), 6) AS stdev,
       round(avg((ground_truth_rank IS NOT NULL)::INT) * 100, 6) AS recall,
       round(avg(coalesce(ground_truth_rank <= 10, FALSE)::INT) * 100, 6) AS hit_rate_at_10,
       count(*) AS total_queries, count(ground_truth_rank) AS found
FROM runs GROUP BY search_type, filter_type"""
    sql["percentile_rule"] = base(RUNS) + rf""",
lists AS (
  SELECT kind || '/' || schema_design || '/' || filter_strategy AS config, list_sort(list(latency_ms)) AS sort_list,
         count(*) AS n, avg(latency_ms) AS avg_ms, median(latency_ms) AS median_ms, min(latency_ms) AS min_ms,
         max(latency_ms) AS max_ms, stddev_samp(latency_ms) AS std_dev,
         avg((ground_truth_rank IS NOT NULL)::INT) AS recall, avg(coalesce(1.0::DOUBLE / ground_truth_rank, 0)) AS mrr
  FROM runs GROUP BY kind, filter_strategy, schema_design
)
SELECT config, round(avg_ms, 6) AS avg_ms, round(median_ms, 6) AS median_ms, {PERCENTILES}, min_ms, max_ms,
       round(std_dev, 6) AS std_dev, round(recall, 6) AS recall, round(mrr, 6) AS mrr, round(1000 / avg_ms, 6) AS qps
FROM lists"""
    sql["quality_report"] = base(RUNS) + r"""
SELECT kind AS search_type, round(avg(coalesce(ground_truth_rank <= 1, FALSE)::INT), 6) AS recall_at_1,
       round(avg(coalesce(ground_truth_rank <= 5, FALSE)::INT), 6) AS recall_at_5,
       round(avg(coalesce(ground_truth_rank <= 10, FALSE)::INT), 6) AS recall_at_10,
       round(avg(coalesce(1.0::DOUBLE / ground_truth_rank, 0)), 6) AS mrr, round(avg(ground_truth_rank), 6) AS avg_rank,
       count(ground_truth_rank) AS found, count(*) AS total_queries, round(avg(latency_ms), 6) AS mean_ms
FROM runs GROUP BY kind"""
    sql["best_config"] = base(RUNS) + r"""
SELECT search_type, arg_min(config, avg_ms) AS config, round(min(avg_ms), 6) AS avg_ms FROM stats GROUP BY search_type"""
    sql["run_summary"] = base(RUNS) + r"""
SELECT count(*) AS total_tests, round(min(avg_ms) FILTER (search_type = 'vector'), 6) AS best_vector_ms,
       round(min(avg_ms) FILTER (search_type = 'text'), 6) AS best_text_ms,
       round(min(avg_ms) FILTER (search_type = 'hybrid'), 6) AS best_hybrid_ms, round(max(qps), 6) AS max_qps
FROM stats"""
    sql["filter_impact"] = base(RUNS) + r"""
SELECT search_type,
       round(max(avg_ms) FILTER (filter_strategy = 'no_filter') / max(avg_ms) FILTER (filter_strategy = 'user_id'), 6)
         AS user_speedup,
       round(max(avg_ms) FILTER (filter_strategy = 'no_filter') / max(avg_ms) FILTER (filter_strategy = 'jsonb'), 6)
         AS jsonb_speedup
FROM stats WHERE schema_design = 'denorm' AND search_type IN ('vector', 'text') GROUP BY search_type"""
    sql["schema_impact"] = base(RUNS) + r"""
SELECT * FROM (
  SELECT search_type, filter_strategy,
         round(max(avg_ms) FILTER (schema_design = 'join') / max(avg_ms) FILTER (schema_design = 'denorm'), 6) AS speedup
  FROM stats WHERE search_type IN ('vector', 'text') AND filter_strategy IN ('no_filter', 'user_id') GROUP BY 1, 2
) WHERE speedup > 0.99"""
    sql["method_comparison"] = base(RUNS) + r"""
SELECT schema_design AS method, round(avg(latency_ms), 6) AS mean, round(median(latency_ms), 6) AS median,
       round(avg((ground_truth_rank IS NOT NULL)::INT) * 100, 6) AS recall, round(avg(latency_ms * 0.5), 6) AS vector_ms,
       round(avg(latency_ms * 0.5) / avg(latency_ms) * 100, 6) AS vector_share
FROM runs GROUP BY schema_design"""
    sql["join_comparison"] = base(RUNS) + r"""
SELECT round(a, 6) AS with_join_ms, round(b, 6) AS without_join_ms, round((a - b) / a * 100, 6) AS improvement_percent,
       round(a / b, 6) AS speedup
FROM (SELECT avg(latency_ms) FILTER (schema_design = 'join') AS a, avg(latency_ms) FILTER (schema_design = 'denorm') AS b
      FROM runs)"""
    sql["timing_reports"] = r"""
WITH lines AS (
  SELECT 'report_' || user_id AS name, event_id AS line_no, value AS ms,
         CASE event_type WHEN 'view' THEN 'Planning Time' WHEN 'click' THEN 'Execution Time' WHEN 'purchase' THEN 'Total Time' END
           AS label
  FROM events
)
SELECT * FROM (
  SELECT name, round(arg_max(ms, line_no) FILTER (label = 'Execution Time'), 2) AS execution_time,
         round(arg_max(ms, line_no) FILTER (label = 'Planning Time'), 2) AS planning_time,
         round(arg_max(ms, line_no) FILTER (label = 'Total Time'), 2) AS total_time
  FROM lines WHERE label IS NOT NULL GROUP BY name
) WHERE total_time IS NOT NULL"""
    sql["config_table"] = base(RUNS) + r"""
SELECT config, search_type, filter_strategy, schema_design, printf('%.2f', avg_ms) AS avg_ms, printf('%.1f', qps) AS qps
FROM stats"""
    return sql
