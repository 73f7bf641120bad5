"""Toxicity: gradient-boosted trees over dense features of a text, with isotonic calibration.

The lexicon holds common insults and what the labels teach: words, and beginnings of words, that documents with label 1 have far
more often.
Features of training rows use the lexicon of the other fold, so that the trees do not trust words they were chosen by. Trees are
fitted on most of the sample and calibrated on the rest. A score is the calibrated probability with a small share of the raw one, which
keeps the order inside a step of the calibration.

The lexicon counts terms over all labelled rows that may be learned; the trees read a bounded sample, SAMPLE labelled rows per class, drawn by hash of the id and weighted back to the labels'
shares; scoring reads every document whole. Only the text enters a score.

Defined cases: a null or empty text has all features 0 and gets the score that goes with them; null labels are ignored, of
repeated labels of an id the larger counts; with labels of one class only, or none, every score is that class (0 if none); repeated
rows get equal scores; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import Broadcast
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinseek.llm.common import stored
from twinseek.llm.repeats import bit_table, maybe_in

# Labelled rows per class that training reads at most, and terms of a lexicon.
SAMPLE, TERMS = 10_000, 600
# A term must be in so many documents of label 1 and raise the odds by this logarithm.
LEAST_DOCUMENTS, LEAST_ODDS = 3, 1.5
BEGINNINGS = (4, 5, 6)
# Columns of term counts: clean and toxic texts of fold 0 and of fold 1; a task hands on that many terms at a time.
COUNTED, HELD_TERMS = ["term", "c0", "t0", "c1", "t1"], 1 << 18
TREES, DEPTH, STEP = 30, 4, 0.2
# One row in CALIBRATED is kept from the trees for calibration; RAW is the share of the uncalibrated score.
CALIBRATED, RAW = 4, 0.02
THRESHOLD = 0.7
NEAR_WORDS = 5
MARKS = "!?.,;:\"'()[]{}<>*_-~#/\\|`…«»„“”¡¿"
# Second-person words in English, German, French and Spanish.
YOU = frozenset(
    "you your yours yourself u ur du dich dir dein deine deiner deinen ihr euch euer tu te toi ton ta tes vous votre vos "
    "tú ti tuyo usted ustedes vos vosotros".split()
)
# Words that count as hits before any label is seen, with their log odds: common insults in the four languages.
KNOWN_ODDS = 4.0
KNOWN = frozenset(
    "idiot idiots stupid moron morons loser losers trash scum pathetic worthless disgusting clown dumb fool jerk imbecile "
    "garbage filthy vermin idioten dumm dummkopf blöd trottel abschaum widerlich wertlos erbärmlich verlierer "
    "imbécile stupide crétin débile minable ordure déchet nul dégoûtant abruti idiota estúpido imbécil tonto basura "
    "escoria patético inútil asqueroso perdedor payaso".split()
)
# Characters that stand for letters in disguised words.
DISGUISE = str.maketrans("013457@$!", "oieastasi")
SHOUT = re.compile(r"[!?]{2,}")
LONG = re.compile(r"([^\W\d_])\1\1")
NAMES = (
    "words hits density odds strongest distinct beginnings beginning_density near_you you capitals shouted "
    "punctuation shouts obfuscated disguised stretched"
).split()


def plain_words(text: str) -> list[str]:
    """Lower-case words without marks around them."""
    return [w for w in (w.strip(MARKS) for w in text.lower().split()) if w]


def terms_of(words: set[str]) -> set[str]:
    """Words, and their beginnings marked by a star."""
    found = {w for w in words if len(w) <= 40}
    for n in BEGINNINGS:
        found |= {w[:n] + "*" for w in words if len(w) >= n}
    return found


def disguised(word: str) -> str | None:
    """The letters a word stands for if signs or digits sit inside it, else None."""
    if word.isalpha():
        return None
    bare = "".join(c for c in word.translate(DISGUISE) if c.isalpha())
    letters = sum(c.isalpha() for c in word)
    return bare if letters * 2 >= len(word) and bare != word and len(bare) > 2 else None


def features(text: str | None, lexicon: dict[str, float]) -> list[float]:
    text = text or ""
    raw = text.split()
    words = plain_words(text)
    n = max(len(words), 1)
    counts = Counter(words)
    hits = total = strongest = distinct = begun = 0.0
    hidden = obfuscated = 0
    hit_words = set()
    for word, times in counts.items():
        odds = lexicon.get(word, 0.0)
        start = max((lexicon.get(word[:k] + "*", 0.0) for k in BEGINNINGS if len(word) >= k), default=0.0)
        if start:
            begun += times
        if not odds and not word.isalpha():
            bare = disguised(word)
            if bare is not None:
                obfuscated += times
                odds = lexicon.get(bare, 0.0)
                hidden += times if odds else 0
        best = max(odds, start)
        if best:
            hit_words.add(word)
            hits += times
            total += times * best
            distinct += 1
            strongest = max(strongest, best)
    near = 0
    people = [i for i, w in enumerate(words) if w in YOU]
    if hit_words and people:
        around = {i + k for i in people for k in range(-NEAR_WORDS, NEAR_WORDS + 1)}
        near = sum(1 for i in around if 0 <= i < len(words) and words[i] in hit_words)
    letters = sum(map(str.isalpha, text)) or 1
    marks = sum(text.count(c) for c in MARKS)
    return [
        math.log1p(len(words)),
        math.log1p(hits),
        hits / n,
        total / n,
        strongest,
        math.log1p(distinct),
        math.log1p(begun),
        begun / n,
        near / n,
        len(people) / n,
        sum(map(str.isupper, text)) / letters,
        sum(1 for w in raw if len(w) > 2 and w.isupper()) / n,
        marks / max(len(text), 1),
        len(SHOUT.findall(text)) / n,
        obfuscated / n,
        math.log1p(hidden),
        len(LONG.findall(text)) / n,
    ]


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned: the checksum of the id leaves remainder 1 by 3."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 3 == 1, F.lit(False))


def _part(n: int, seed: int) -> Column:
    return F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(n)).cast("int")


def learnable_labels(labels: DataFrame) -> DataFrame:
    """doc_id and toxic (0 or 1), once for each id whose label may be learned."""
    known = labels.filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id")
    return stored(known.agg(F.max("toxic").cast("double").alias("toxic")).filter(F.col("toxic").isin(0.0, 1.0)), "labels")


def examples(docs: DataFrame, known: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Texts of a bounded sample of the labelled rows that may be learned: doc_id, toxic, weight, fold, part, text."""
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    drawn = None
    for label, n in sorted(sizes.items()):
        of = known.filter(F.col("toxic") == label).orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id").limit(sample)
        of = of.withColumn("weight", F.lit(n / min(n, sample)))
        drawn = of if drawn is None else drawn.unionByName(of)
    if drawn is None:
        drawn = known.withColumn("weight", F.lit(1.0)).limit(0)
    # at most two classes times `sample` rows of two numbers: bounded whatever the corpus
    chosen = F.broadcast(stored(drawn, "sample"))
    return stored(
        docs.select("doc_id", "text")
        .join(chosen, "doc_id")
        .withColumn("fold", _part(2, 11))
        .withColumn("part", _part(CALIBRATED, 13)),
        "examples",
    )


def learnable(docs: DataFrame, known: DataFrame) -> DataFrame:
    """Texts of all labelled rows that may be learned: toxic, fold, text.

    Both sides are shuffled at every size; a bit table of the labelled ids keeps most other texts out of the shuffle.
    """
    table = bit_table(known, "doc_id")

    def labelled(ids: pa.Array) -> pa.Array:
        return pa.array(maybe_in(table.value, ids.to_numpy(zero_copy_only=False)))

    own = docs.select("doc_id", "text").filter(F.col("doc_id").isNotNull())
    own = own.filter(F.arrow_udf(labelled, "boolean")(F.col("doc_id").cast("long")))
    return own.join(known.hint("merge"), "doc_id").select("toxic", _part(2, 11).alias("fold"), "text")


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Terms and in how many texts of each fold and label they are; handed on in parts, which Spark adds up."""
    counts: dict[str, list[int]] = {}

    def handed() -> pa.RecordBatch:
        columns = list(zip(*counts.values(), strict=True))
        return pa.record_batch([pa.array(list(counts), pa.string()), *[pa.array(c, pa.int64()) for c in columns]], COUNTED)

    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("text", "fold", "toxic"))
        for text, fold, toxic in zip(*columns, strict=True):
            place = 2 * fold + int(toxic)
            for term in terms_of(set(plain_words(text or ""))):
                counts.setdefault(term, [0, 0, 0, 0])[place] += 1
            if len(counts) >= HELD_TERMS:
                yield handed()
                counts = {}
    if counts:
        yield handed()


def lexicons(rows: DataFrame) -> list[dict[str, float]]:
    """Lexicon of fold 0, of fold 1 and of both: term to log odds. TERMS entries at most reach the driver for each."""
    schema = f"{COUNTED[0]} string, " + ", ".join(f"{c} long" for c in COUNTED[1:])
    own = rows.select("text", "fold", "toxic").mapInArrow(_count_terms, schema)
    summed = own.groupBy("term").agg(*[F.sum(c).alias(c) for c in COUNTED[1:]])
    # only sums over all tasks tell which terms are too rare
    counted = stored(summed.filter(F.col("t0") + F.col("t1") >= LEAST_DOCUMENTS), "terms")
    sizes = {(r["fold"], r["toxic"]): r["n"] for r in rows.groupBy("fold", "toxic").agg(F.count("*").alias("n")).collect()}
    found = []
    for folds in ((0,), (1,), (0, 1)):
        bad = sum((F.col(f"t{i}") for i in folds), F.lit(0))
        good = sum((F.col(f"c{i}") for i in folds), F.lit(0))
        n_bad, n_good = (sum(sizes.get((i, label), 0) for i in folds) for label in (1.0, 0.0))
        odds = F.log((bad + 0.5) / (n_bad + 1.0)) - F.log((good + 0.5) / (n_good + 1.0))
        best = (
            counted.select("term", bad.alias("bad"), odds.alias("odds"))
            .filter((F.col("bad") >= LEAST_DOCUMENTS) & (F.col("odds") >= LEAST_ODDS))
            .orderBy((F.col("bad") * F.col("odds")).desc(), "term")
            .limit(TERMS)
        )
        found.append(dict.fromkeys(KNOWN, KNOWN_ODDS) | {r["term"]: r["odds"] for r in best.collect()})
    return found


def vectors(text: Column, shipped: Broadcast, which: Column | None = None) -> Column:
    """Dense features of a text under one of the shipped lexicons (the last unless `which` names another)."""

    def computed(texts: pa.Array, number: pa.Array) -> pa.Array:
        lexica = shipped.value
        rows = [features(t, lexica[i]) for t, i in zip(texts.to_pylist(), number.to_pylist(), strict=True)]
        return pa.array(rows, pa.list_(pa.float64()))

    return F.arrow_udf(computed, "array<double>")(text, F.lit(2) if which is None else which)


@dataclass(frozen=True)
class Model:
    lexica: Broadcast
    trees: GBTClassificationModel | None
    calibration: IsotonicRegressionModel | None
    constant: float = 0.0


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    known = learnable_labels(labels)
    rows = examples(docs, known, sample)
    classes = {r[0] for r in rows.select("toxic").distinct().collect()}
    spark = rows.sparkSession
    if len(classes) < 2:
        return Model(spark.sparkContext.broadcast([{}, {}, {}]), None, None, max(classes, default=0.0))
    lexica = spark.sparkContext.broadcast(lexicons(learnable(docs, known)))
    other = (F.lit(1) - F.col("fold")).cast("int")
    table = stored(rows.select("toxic", "weight", "part", vectors(F.col("text"), lexica, other).alias("x")), "features")
    table = table.withColumn("features", array_to_vector("x"))
    trees = GBTClassifier(
        labelCol="toxic", weightCol="weight", maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, seed=17, featureSubsetStrategy="all"
    )
    fitting, kept = table.filter(F.col("part") > 0), table.filter(F.col("part") == 0)
    if fitting.select("toxic").distinct().count() < 2 or kept.select("toxic").distinct().count() < 2:
        fitting = kept = table
    fitted = trees.fit(fitting)
    raw = fitted.transform(kept).select("toxic", "weight", vector_to_array("probability")[1].alias("raw"))
    isotonic = IsotonicRegression(labelCol="toxic", featuresCol="raw", weightCol="weight", predictionCol="calibrated")
    return Model(lexica, fitted, isotonic.fit(stored(raw, "raw")))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """The documents as a struct `row` and their score."""
    packed = docs.select(F.struct("*").alias("row"), F.col("text").alias("__text"))
    if model.trees is None:
        return packed.select("row", F.lit(float(model.constant)).alias("score"))
    table = packed.select("row", array_to_vector(vectors(F.col("__text"), model.lexica)).alias("features"))
    table = model.trees.transform(table).select("row", vector_to_array("probability")[1].alias("raw"))
    score = F.col("calibrated") * (1 - RAW) + F.col("raw") * RAW
    return model.calibration.setFeaturesCol("raw").transform(table).select(
        "row", F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)).alias("score")
    )
