"""Secret scans over an incremental ledger of content-addressed texts, in DataFrame functions only.

Every version of every path is addressed by the digest of its text. Only (digest, rule version) pairs that the ledger does not
hold are scanned, each once however many paths share the text; findings are joined back to all paths through the digest.
A rule's version is a digest of its pattern, so a changed rule is scanned anew and unchanged ones are not.

Spans are counted in code points. A rule's matches are leftmost and do not overlap; the text between matches (`split`) and the
matches (`regexp_extract_all`) give the positions as running sums, so a text with very many matches costs linear time.

Defined cases: a null text is the empty text; a null path is an ordinary path; repeated rows each get the findings; an empty
table gives an empty ledger and report.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from twinseek.llm.common import stored, whole_text


@dataclass(frozen=True)
class Rule:
    """A kind of secret. `part` is the group whose length must reach `least`."""

    kind: str
    pattern: str
    part: int
    least: int

    @property
    def version(self) -> str:
        return hashlib.sha256(f"{self.kind}\0{self.pattern}\0{self.part}\0{self.least}".encode()).hexdigest()[:16]


# Fixed values of the contract. In the second and third rule the least length is part of the pattern: a match of the plain
# pattern is a whole run, so runs that are too short may be left out by the pattern itself. In the first it must not be.
RULES = (
    Rule(
        "assign",
        r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        6,
    ),
    Rule("access", r"AKIA[A-Z0-9]{16,}+", 0, 20),
    Rule("hex", r"(?<![0-9a-f])[0-9a-f]{24,}+", 0, 24),
)
MARK = "[SECRET]"
SPANS = "array<struct<start:int,end:int>>"
FOUND = "array<struct<start:int,kind:int,end:int>>"


def addressed(versions: DataFrame, text: str = "text") -> DataFrame:
    """The versions with the digest of their text in `__blob`."""
    return versions.withColumn("__blob", F.sha2(F.encode(whole_text(text), "UTF-8"), 256))


def _lengths(texts: Column) -> Column:
    return F.transform(texts, lambda x: F.length(x))


def _matches(text: Column, rule: Rule) -> Column:
    """Lengths of the gap before each match, of the match and of its part; null where the rule does not match at all."""
    pattern = F.lit(rule.pattern)
    zipped = F.arrays_zip(
        _lengths(F.split(text, rule.pattern, -1)).alias("gap"),
        _lengths(F.regexp_extract_all(text, pattern, F.lit(0))).alias("length"),
        _lengths(F.regexp_extract_all(text, pattern, F.lit(rule.part))).alias("part"),
    )
    return F.when(text.rlike(rule.pattern), zipped)


def scan(versions: DataFrame, ledger: DataFrame | None = None, rules=RULES, text: str = "text") -> DataFrame:
    """New ledger rows (blob, rule, spans): one for each pair of text and rule version that the ledger does not hold yet.

    Pairs without a finding are kept with no spans, so they are not scanned again.
    """
    blobs = addressed(versions, text).select(F.col("__blob").alias("blob"), whole_text(text).alias("text"))
    blobs = blobs.dropDuplicates(["blob"])
    seen = F.array().cast("array<string>")
    if ledger is not None:
        before = ledger.groupBy("blob").agg(F.collect_set("rule").alias("seen"))
        blobs, seen = blobs.join(before, "blob", "left"), F.coalesce("seen", seen)
    pairs = [
        F.when(
            ~F.array_contains(seen, r.version),
            F.struct(
                F.lit(r.version).alias("rule"), F.lit(r.least).alias("least"), _matches(F.col("text"), r).alias("matches")
            ),
        )
        for r in rules
    ]
    unseen = blobs.select("blob", F.explode(F.filter(F.array(*pairs), lambda x: x.isNotNull())).alias("of"))
    each = unseen.select("blob", "of.rule", "of.least", F.posexplode_outer("of.matches").alias("number", "m"))
    upto = Window.partitionBy("blob", "rule").orderBy("number").rowsBetween(Window.unboundedPreceding, 0)
    placed = each.withColumn("end", F.sum(F.col("m.gap") + F.col("m.length")).over(upto).cast("int"))
    span = F.when(
        F.col("m.length").isNotNull() & (F.col("m.part") >= F.col("least")),
        F.struct((F.col("end") - F.col("m.length")).cast("int").alias("start"), "end"),
    )
    return placed.groupBy("blob", "rule").agg(F.sort_array(F.collect_list(span)).cast(SPANS).alias("spans"))


def report(versions: DataFrame, ledger: DataFrame, rules=RULES, text: str = "text") -> DataFrame:
    """All versions of all paths with the spans that the given rules found in their text (column `__spans`)."""
    versions_of = F.array(*[F.lit(r.version) for r in rules])
    kind = (F.array_position(versions_of, F.col("rule")) - 1).cast("int")
    known = (
        ledger.withColumn("kind", kind)
        .filter(F.col("kind") >= 0)
        .groupBy(F.col("blob").alias("__blob"))
        .agg(
            F.sort_array(
                F.flatten(
                    F.collect_list(
                        F.transform("spans", lambda s: F.struct(s["start"].alias("start"), F.col("kind"), s["end"].alias("end")))
                    )
                )
            )
            .cast(FOUND)
            .alias("spans")
        )
    )
    # stored, so that the join below reads two plain exchanges and a text with very many paths can be split at run time
    known = stored(known.filter(F.size("spans") > 0).withColumnRenamed("spans", "__spans"), "findings")
    return (
        addressed(versions, text)
        .join(known, "__blob", "left")
        .withColumn("__spans", F.coalesce("__spans", F.array().cast(FOUND)))
        .drop("__blob")
    )


def counted(spans: Column, kind: int) -> Column:
    """Number of spans of one kind."""
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def written(spans: Column, rules=RULES) -> Column:
    """kind:start:end, comma-joined in the order of the spans."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["end"])), ","
    )


def _masked(least: int):
    def mask(match: Column, secret: Column) -> Column:
        kept = F.left(match, F.length(match) - F.length(secret))
        return F.when(F.length(secret) >= least, F.concat(kept, F.lit(MARK))).otherwise(match)

    return mask


def redacted(text: Column, rules=RULES) -> Column:
    """The text with the secret part of every finding replaced by a mark, in linear time.

    Rules run one after another. A match whose part is too short stays; the pieces around the matches are joined again.
    """
    for rule in rules:
        whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
        part = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.part))
        masked = F.zip_with(whole, part, _masked(rule.least))
        gaps = F.split(text, rule.pattern, -1)
        joined = F.array_join(F.zip_with(gaps, masked, lambda g, m: F.concat(g, F.coalesce(m, F.lit("")))), "")
        text = F.when(text.rlike(rule.pattern), joined).otherwise(text)
    return text


def redacted_rows(docs: DataFrame, rules=RULES) -> DataFrame:
    """All rows and columns; texts with findings have them masked, and `n_chars`, if there is such a column, follows."""
    other = F.struct(F.lit(0).alias("_"), *[F.col(c) for c in docs.columns if c != "text"]).alias("__row")
    versions = docs.select(other, "text")
    ledger = stored(scan(versions, rules=rules), "ledger")
    found = report(versions, ledger, rules)
    text = F.when(F.size("__spans") > 0, redacted(F.col("text"), rules)).otherwise(F.col("text"))
    masked = found.select("__row", text.alias("text"), (F.size("__spans") > 0).alias("__hit"))
    columns = []
    for c in docs.columns:
        value = F.col("text") if c == "text" else F.col("__row").getField(c)
        if c == "n_chars":
            value = F.when(F.col("__hit"), F.length("text").cast(docs.schema[c].dataType)).otherwise(value)
        columns.append(value.alias(c))
    return masked.select(*columns)
