"""Hand-made cases for the column functions."""

import json

import pytest
from pyspark.sql import functions as F

from twinseek.functions import fulltext, scores, stemming, vectors
from twinseek.functions import json as js
from twinseek.functions import text as tx
from twinseek.sources import evalfiles


def one(spark, column, **values):
    names = ", ".join(f"{n} {t}" for n, (t, _) in values.items()) or "x int"
    row = tuple(v for _, v in values.values()) or (1,)
    return spark.createDataFrame([row], names).select(column.alias("r")).first()["r"]


@pytest.mark.parametrize(
    "word, expected",
    [
        ("machine", "machin"), ("learning", "learn"), ("science", "scienc"), ("technology", "technolog"),
        ("hopping", "hop"), ("hoping", "hope"), ("relational", "relat"), ("conditional", "condit"), ("dies", "die"),
        ("cries", "cri"), ("gas", "gas"), ("kiwis", "kiwi"), ("generously", "generous"), ("communication", "communic"),
        ("news", "news"), ("controlled", "control"), ("agreed", "agre"), ("happily", "happili"), ("sky", "sky"),
        ("say", "say"), ("by", "by"), ("succeeding", "succeed"), ("knightly", "knight"),
    ],
)
def test_stems(word, expected):
    assert stemming.stem(word) == expected


def test_stop_words_have_no_lexeme():
    assert stemming.normalise_english("the") is None
    assert len(stemming.STOP_WORDS) == 127


def test_text_vector_keeps_positions_of_dropped_words(spark):
    vector = one(spark, fulltext.text_vector(F.col("t"), "english"), t=("string", "The cats sat, the CAT slept"))
    assert [(e["lexeme"], e["positions"]) for e in vector] == [("cat", [2, 5]), ("sat", [3]), ("slept", [6])]


@pytest.mark.parametrize(
    "query, dictionary, expected",
    [
        ("Machine learning", "english", [([["machin@0"], ["learn@0"]], [])]),
        ('"cat on the mat"', "english", [([["cat@0", "mat@3"]], [])]),
        ('a or "b c" -d', "simple", [([["a@0"]], []), ([["b@0", "c@1"]], [["d@0"]])]),
        ("x x", "simple", [([["x@0"]], [])]),
        ("the of", "english", []),
        ("   ", "english", []),
        (None, "english", []),
    ],
)
def test_compiled_queries(spark, query, dictionary, expected):
    compiled = one(spark, fulltext.compile_query(F.col("q"), dictionary), q=("string", query))

    def items(xs):
        return [[f"{w['lex']}@{w['off']}" for w in x] for x in xs]

    assert [(items(g["must"]), items(g["must_not"])) for g in compiled] == expected


RANKS = [
    ("x y a a a a a a a x", "x y", 0.1125),
    ("x a x b x", "x", 0.3),
    ("a b", "b a", 0.1),
    ("a c b", "a b", 0.05),
    ("a b", "a z", None),
    ("the quick fox", '"quick fox"', 0.1),
    ("quick the fox", '"quick fox"', None),
    ("a b", "a -b", None),
    ("a c", "a -b", 0.1),
    ("c c", "-b", 0.0),
    ("a d", "b or d", 0.1),
    ("a b c", '"a b" b', 0.1),
]


def test_match_and_cover_density(spark):
    rows = spark.createDataFrame([(i, t, q) for i, (t, q, _) in enumerate(RANKS)], "i int, t string, query_text string").select(
        "i",
        fulltext.text_vector(F.col("t"), "simple").alias("text_search_vector"),
        fulltext.compile_query(F.col("query_text"), "simple").alias("query"),
    )
    q = F.col("query")
    rows = rows.withColumns({"lexemes": fulltext.query_lexemes(q), "required": fulltext.required_words(q)})
    rows = rows.withColumn("groups", fulltext.groups_column()).select(
        "i", fulltext.first_match(F.col("groups")).alias("m"), fulltext.relevance_column().alias("r")
    )
    found = {r["i"]: r["r"] if r["m"] else None for r in rows.collect()}
    for i, (_, _, expected) in enumerate(RANKS):
        assert found[i] == (None if expected is None else pytest.approx(expected)), RANKS[i]


CONTAINED = [
    ({"a": 1}, True), ({"a": "1"}, False), ({"b": [2]}, True), ({"b": [3]}, False), ({}, True), ({"b": [2, 2, 1]}, True),
    ({"c": {"d": True}}, True), ({"c": {"d": "true"}}, False), ({"n": None}, True), ({"a": None}, False), ({"z": 1}, False),
    ({"e": [{"f": 1}]}, True), ({"a": 1.0}, True), ({"a": True}, False), ({"a": [1]}, False),
]


def test_json_containment(spark):
    meta = json.dumps({"a": 1, "b": [1, 2], "c": {"d": True}, "n": None, "e": [{"f": 1, "g": 2}]})
    found = one(spark, F.array(*[js.json_contains(F.col("m"), wanted) for wanted, _ in CONTAINED]), m=("string", meta))
    assert list(zip([w for w, _ in CONTAINED], found)) == CONTAINED


def test_json_lookups(spark):
    meta = '{"a": null, "b": "x", "c": "true", "d": "4.5"}'
    m = F.col("m")
    assert one(spark, js.json_has_key(m, "a"), m=("string", meta)) is True
    assert one(spark, js.json_has_key(m, "z"), m=("string", meta)) is False
    assert one(spark, js.json_bool(m, "b"), m=("string", meta)) is None
    assert one(spark, js.json_bool(m, "c"), m=("string", meta)) is True
    assert one(spark, js.json_between(m, "d", 4, 5), m=("string", meta)) is True
    assert one(spark, js.json_default(js.json_text(m, "z"), "middle"), m=("string", meta)) == "middle"


@pytest.mark.parametrize("i, total, label", [(0, 4, "beginning"), (1, 4, "middle"), (2, 4, "end"), (3, 4, "end"), (0, 1, "beginning")])
def test_position(spark, i, total, label):
    assert one(spark, tx.position_label(F.col("i"), F.col("n")), i=("int", i), n=("int", total)) == label


@pytest.mark.parametrize("text, flags", [
    ("def f(): return", (True, False, False, False)),
    ("```x```", (True, False, False, False)),
    ("a = b", (False, True, False, False)),
    ("• item", (False, False, True, False)),
    ("|a|b|c|", (False, False, False, False)),
    ("|a|b|c|d|", (False, False, False, True)),
    ("Import Class", (False, False, False, False)),
])
def test_marker_flags(spark, text, flags):
    c = F.col("t")
    found = one(spark, F.array(tx.has_code(c), tx.has_math(c), tx.has_list(c), tx.has_table(c)), t=("string", text))
    assert tuple(found) == flags


def test_text_shapes(spark):
    t = F.col("t")
    assert one(spark, tx.truncate(t, 5), t=("string", "abcde")) == "abcde"
    assert one(spark, tx.truncate(t, 5), t=("string", "abcdef")) == "abcde..."
    assert one(spark, tx.preview(t, 5), t=("string", "ab")) == "ab..."
    assert one(spark, tx.word_count(t), t=("string", " a b c\n d ")) == len(" a b c\n d ".split())
    long = "short\n  a line of more than twenty characters that goes on and on for more than ten words  \nx"
    assert one(spark, tx.keyword_query_text(t), t=("string", long)) == "a line of more than twenty characters that goes on"
    assert one(spark, tx.keyword_query_text(t), t=("string", "a b\nc")) == "a b c"
    assert one(spark, tx.title_label(t), t=("string", "user_only")) == "User Only"


def test_vectors(spark):
    v = F.col("v")
    assert one(spark, vectors.parse_vector(v), v=("string", "[1.5, -2,,]")) == [1.5, -2.0]
    assert one(spark, vectors.format_vector(v), v=("array<float>", [1.5, -2.0])) == "[1.5,-2.0]"
    distance = vectors.negative_inner_product(v, vectors.vector_literal([2, 1]))
    assert one(spark, distance, v=("array<float>", [1.0, 3.0])) == -5.0
    with pytest.raises(Exception, match="expected 3 dimensions"):
        one(spark, vectors.require_dimension(v, 3), v=("array<float>", [1.0]))


def test_scores(spark):
    r = F.col("r")
    assert one(spark, scores.reciprocal_rank(r, 50), r=("long", 2)) == pytest.approx(1 / 52)
    assert one(spark, scores.reciprocal_rank(r, 50), r=("long", None)) is None
    assert one(spark, scores.reciprocal_rank(r, 60, 1000), r=("long", None)) == pytest.approx(1 / 1060)
    assert one(spark, scores.improvement_percent(F.lit(4.0), F.lit(3.0))) == 25.0
    assert one(spark, scores.ratio(F.lit(4.0), F.lit(0.0))) is None


@pytest.mark.parametrize(
    "text, expected",
    [
        ('{"a": 1}', {"a": 1}), ("{'a': 'x', 'b': True, 'c': None}", {"a": "x", "b": True, "c": None}),
        ("not a dict", {}), (None, {}), ("{'a': ['x', 'y'], 'n': 1.5}", {"a": ["x", "y"], "n": 1.5}),
    ],
)
def test_meta_literals(spark, text, expected):
    assert json.loads(one(spark, evalfiles.meta_json(F.col("m")), m=("string", text))) == expected
