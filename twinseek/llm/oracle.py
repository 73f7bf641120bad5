"""SQL that must agree with the registered queries of the training-data operators, where SQL can express them."""

def _matches(kind: str, number: int, pattern: str, group: int, least: int) -> str:
    """Matches of one rule with start and end: the text between matches and the matches give running sums."""
    return f"""
    SELECT doc_id, '{kind}' AS kind, {number} AS place, stop - length(m) AS start, stop FROM (
      SELECT doc_id, m, part, sum(length(gap) + length(m)) OVER (PARTITION BY doc_id ORDER BY i) AS stop FROM (
        SELECT doc_id, unnest(range(1, len(ms) + 1)) AS i, unnest(gaps[1:len(ms)]) AS gap, unnest(ms) AS m, unnest(parts) AS part
        FROM (SELECT doc_id, string_split_regex(text, '{pattern}') AS gaps, regexp_extract_all(text, '{pattern}') AS ms,
                     regexp_extract_all(text, '{pattern}', {group}) AS parts FROM texts)
      )
    ) WHERE length(part) >= {least}"""



def _cheaper(*options: str) -> str:
    """The least (cost, audit) of some states of the walk over a conversation's turns; each with its text so far."""
    return f"list_sort([{', '.join(options)}])[1]"


def _step(state: str, cost: str, edit: str, said: str | None = None) -> str:
    text = f"{state}.o" if said is None else f"{state}.o || chr(10) || {said}"
    return f"{{'c': {state}.c + {cost}, 'a': {state}.a || {edit}, 'o': {text}}}"


def _role(initial: str, role: str) -> tuple[str, str, str]:
    return f"CASE WHEN x = '{initial}' THEN 0 ELSE 2 END + cut", f"CASE WHEN x = '{initial}' THEN 'K' ELSE 'R' END", (
        f"CASE WHEN x = '{initial}' THEN role ELSE '{role}' END || ':' || text"
    )


_FAR = "{'c': 1000000000, 'a': '', 'o': ''}"


def _deleted(state: str) -> str:
    return _step(state, "3", "'D'")


def _either(kept: str, state: str) -> str:
    return f"CASE WHEN gone THEN {_deleted(state)} ELSE {kept} END"


def _walk() -> str:
    """One turn further: s at the start, u and a where these come next, f behind the s."""
    to_a = [_step(k, *_role("u", "user")) for k in ("s", "u", "f")]
    to_u = _step("a", *_role("a", "assistant"))
    kept_s = _step("s", "cut", "'K'", "role || ':' || text")
    to_f = f"CASE WHEN x = 's' THEN {kept_s} ELSE {_FAR} END"
    return f"""
      SELECT conv_id, i, {_deleted('s')} AS s,
        {_either(_cheaper(_deleted('u'), to_u), 'u')} AS u,
        {_either(_cheaper(_deleted('a'), *to_a), 'a')} AS a,
        {_either(_cheaper(_deleted('f'), to_f), 'f')} AS f"""


def _inserted(state: str, role: str) -> str:
    return _step(state, "2", "'I'", f"'{role}:'")


_TO_A = _cheaper("a", *[_inserted(k, "user") for k in ("s", "u", "f")])
_TO_U = _cheaper("u", _inserted("n", "assistant"))
_CRC_TABLE = """[list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0],
      lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) FOR n IN range(0, 256)]"""
_ASSIGN = (
    r"(?i)(password|passwd|secret|token|api_?key)[\"'']?\x20*[:=]\x20*[\"'']?([A-Za-z0-9+/_.=-]+)"
)
STATEMENTS = {
    "op1_substring_dedup": r"""
    WITH texts AS (SELECT doc_id, [x FOR x IN string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+') IF x <> ''] AS w
      FROM documents),
    begins AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM texts),
    windows AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS k FROM begins),
    firsts AS (SELECT k, min(doc_id) AS least FROM windows GROUP BY k),
    gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM windows JOIN firsts USING (k) WHERE least < doc_id),
    words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM texts),
    kept AS (SELECT doc_id, count(g.p) AS n_removed, string_agg(word, ' ' ORDER BY w.p) FILTER (g.p IS NULL) AS rest
      FROM words w LEFT JOIN gone g USING (doc_id, p) GROUP BY doc_id)
    SELECT doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(rest, '')) AS kept_sha256
    FROM texts LEFT JOIN kept USING (doc_id)
    """,
    "op6_suffix_dedup": """
    WITH texts AS (SELECT doc_id, hex(coalesce(text, '')) AS h FROM documents),
    cuts AS (SELECT doc_id, h, unnest(range(0, (len(h) // 2 + 199) // 200)) AS c FROM texts),
    parts AS (SELECT doc_id, c, substr(h, 400 * c + 1, 400 + 98) AS part FROM cuts),
    places AS (SELECT doc_id, c, part, unnest(range(0, least(200, len(part) // 2))) AS j FROM parts),
    bytes AS (SELECT doc_id, 200 * c + j AS p, substr(part, 2 * j + 1, 2) AS b, substr(part, 2 * j + 1, 100) AS k FROM places),
    firsts AS (SELECT k, min(doc_id) AS least FROM bytes WHERE len(k) = 100 GROUP BY k),
    gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS p FROM bytes JOIN firsts USING (k) WHERE least < doc_id),
    marked AS (SELECT doc_id, p, b, g.p IS NOT NULL AS removed FROM bytes LEFT JOIN gone g USING (doc_id, p)),
    runs AS (SELECT *, removed AND NOT coalesce(lag(removed) OVER (PARTITION BY doc_id ORDER BY p), false) AS begins
      FROM marked),
    kept AS (SELECT doc_id, count(*) FILTER (removed) AS n_removed, count(*) FILTER (begins) AS n_spans,
      string_agg(b, '' ORDER BY p) FILTER (NOT removed) AS rest FROM runs GROUP BY doc_id)
    SELECT doc_id, len(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
      sha256(unhex(coalesce(rest, ''))) AS kept_sha256
    FROM texts LEFT JOIN kept USING (doc_id)
    """,
    "op3_topk": """
    WITH part AS (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings
      WHERE embedding IS NOT NULL
      AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
    whole AS (SELECT vec_id, i, CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) AS x FROM part),
    scored AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score
      FROM whole q JOIN whole c ON q.i = c.i AND q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0 GROUP BY ALL),
    ranked AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score
      FROM scored)
    SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 10
    """,
    "op9_secrets": f"""
    WITH texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
    found AS ({_matches("assign", 0, _ASSIGN, 2, 6)}
      UNION ALL {_matches("access", 1, "AKIA[A-Z0-9]+", 0, 20)}
      UNION ALL {_matches("hex", 2, "[0-9a-f]+", 0, 24)}),
    listed AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
      count(*) FILTER (kind = 'hex') AS n_hex,
      string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY start, place) AS spans
      FROM found GROUP BY doc_id)
    SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
      sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
    FROM documents LEFT JOIN listed USING (doc_id)
    """,
    "op11_hard_negatives": """
    WITH part AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, unnest(embedding) AS x,
      generate_subscripts(embedding, 1) AS i FROM embeddings WHERE embedding IS NOT NULL AND label IS NOT NULL
      AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
    whole AS (SELECT vec_id, label, i, CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) AS x FROM part),
    scored AS (SELECT q.vec_id AS anchor_id, c.vec_id, q.label = c.label AS alike, CAST(sum(q.x * c.x) AS BIGINT) AS score
      FROM whole q JOIN whole c ON q.i = c.i AND q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0 GROUP BY ALL),
    positives AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE alike
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
    SELECT anchor_id, positive_id, CAST(row_number() OVER best AS INTEGER) AS rank, vec_id AS negative_id, positive_score,
      score AS negative_score
    FROM positives JOIN scored USING (anchor_id)
    WHERE NOT alike AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
    WINDOW best AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER best <= 10
    """,
    "op12_conversation_repair": f"""
    WITH RECURSIVE steps AS (SELECT {_CRC_TABLE} AS t),
    named AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
      coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
    numbered AS (SELECT conv_id, turn, role, text,
      xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], [CAST(ord(x) AS BIGINT) FOR x IN string_split(k, '')]),
        lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295) % 20 AS d FROM named, steps),
    damaged AS (SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role,
      CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
      unnest(range(0, CASE d WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM numbered),
    trimmed AS (SELECT *, rtrim(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') AS rest,
      md5(CAST(length(role) AS VARCHAR) || ':' || role || ':' || text) AS name FROM damaged),
    placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, name, copy) AS i,
      row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again,
      substr(role, 1, 1) AS x FROM trimmed),
    judged AS (SELECT *, rest = '' AS is_blank, rest <> '' AND again AS is_again, rest = '' OR again AS gone,
      CAST(right(rest, 1) NOT IN ('.', '!', '?') AS INTEGER) AS cut,
      lag(x) OVER (PARTITION BY conv_id ORDER BY i) || x AS met FROM placed),
    walk AS (SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS i, {{'c': 0, 'a': '', 'o': ''}} AS s, {_FAR} AS u, {_FAR} AS a,
        {_FAR} AS f FROM judged
      UNION ALL {_walk()}
      FROM (SELECT b.conv_id, j.i, s, {_TO_U} AS u, n AS a, f, x, gone, cut, role, text
        FROM (SELECT *, {_TO_A} AS n FROM walk) b
        JOIN judged j ON j.conv_id IS NOT DISTINCT FROM b.conv_id AND j.i = b.i + 1)),
    counted AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
      count(*) FILTER (is_blank) AS blank, count(*) FILTER (is_again) AS duplicate,
      count(*) FILTER (NOT gone AND cut = 1) AS truncated, count(*) FILTER (met NOT IN ('su', 'ua', 'au')) AS illegal,
      max(i) AS i FROM judged GROUP BY conv_id),
    ended AS (SELECT c.*, CASE WHEN w.s <= w.e THEN w.s ELSE w.e END AS best FROM counted c
      JOIN (SELECT *, {_TO_U} AS e FROM (SELECT *, {_TO_A} AS n FROM walk)) w ON w.conv_id IS NOT DISTINCT FROM c.conv_id AND w.i = c.i)
    SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
      coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(best.c, 0) AS BIGINT) AS cost,
      coalesce(best.a, '') AS audit, sha256(coalesce(substr(best.o, 2), '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN ended e ON a.conv_id IS NOT DISTINCT FROM e.conv_id
    """,
    "op13_warc": """
    WITH payloads AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes,
      sha256(coalesce(html, '')) AS payload_digest FROM pages),
    placed AS (SELECT *, payload_bytes >= 100 AND row_number() OVER (PARTITION BY payload_digest ORDER BY page_id NULLS LAST) > 1
      AS again, min(page_id) OVER (PARTITION BY payload_digest) AS least FROM payloads)
    SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
      CASE WHEN again THEN least END AS refers_to
    FROM placed
    """,
}
