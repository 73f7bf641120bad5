"""Repair of the structure of conversations: turns aligned to `(s?(ua)+)?` at least cost, with an audit of the edits.

Turns stand in order of their number, null first, those of one number in order of the md5 name of role and text. Each turn has at most one
fault: blank, else a repetition of an earlier turn of the conversation, else cut off before `.`, `!` or `?`. Blank and repeated
turns have to go; how the others are kept, renamed or deleted, and what is inserted, says `turn_alignment`.

Texts are shuffled once. What decides about a turn is a name, an initial and two flags; these are counted to one row per conversation,
number and name, range-sorted by those three, and every task turns its range into one character a turn. A conversation that holds a
third of all turns is thus spread over many ranges; only its characters are gathered, as its audit is gathered by nature. The texts then
meet the audit in order and pass as a stream: a worker holds a batch, never a conversation. A digest over a conversation's whole
text has to see it in order, so that one stream is the work of one task.

Defined cases: a null role or text counts as one space; null numbers stand first and count for no gap; a null conversation id is a
conversation like any other; turns alike in number, role and text are repetitions of one another; a role without s, u or a as
its initial fits no place; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinseek.llm import turn_alignment

SPACES = " \t\n\x0b\x0c\r"
ENDS = (".", "!", "?")
GAPLESS = {"su", "ua", "au"}
ROLES = {"u": "user", "a": "assistant"}
FOUND = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
PIECE = "conv_id long, part long, codes string, blank long, duplicate long, truncated long, first long, last long, turns long"
# Conversations that a task hands on together.
HANDED = 1024


def _known(rows: DataFrame) -> DataFrame:
    """The turns with their name: a digest of role and text."""
    role, text = (F.coalesce(c, F.lit(" ")) for c in ("role", "text"))
    return rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text")
    ).withColumn("name", F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", F.lit(":"), "text")))


def _faults(known: DataFrame) -> DataFrame:
    """conv_id, turn, name, n, initial, blank, cut, first: one row per conversation, number and name, without texts."""
    trimmed = F.rtrim("text", F.lit(SPACES))
    runs = known.groupBy("conv_id", "turn", "name").agg(
        F.count("*").alias("n"),
        F.max(F.substring("role", 1, 1)).alias("initial"),
        F.max(trimmed == "").alias("blank"),
        F.max(~F.substring(trimmed, -1, 1).isin(*ENDS)).alias("cut"),
    )
    # names that come under several numbers are few; the others are first where they are
    again = (
        runs.groupBy(F.col("conv_id").alias("c"), F.col("name").alias("m"))
        .agg(F.count("*").alias("turns"), F.min(F.struct("turn")).alias("earliest"))
        .filter(F.col("turns") > 1)
    )
    joined = runs.join(again, F.equal_null("conv_id", "c") & (F.col("name") == F.col("m")), "left")
    first = F.coalesce(F.equal_null("turn", "earliest.turn"), F.lit(True)) | F.col("turns").isNull()
    return joined.select(*runs.columns, first.alias("first"))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per conversation of a range its turns as characters, and counts; a cut conversation has a piece in each of its ranges."""
    part = TaskContext.get().partitionId()
    fields = [f.split()[0] for f in PIECE.split(", ")]
    kinds = pa.schema([(name, pa.string() if name == "codes" else pa.int64()) for name in fields])
    done: list[dict] = []
    piece: dict | None = None

    def closed() -> None:
        if piece is not None:
            piece["codes"] = "".join(piece["codes"])
            done.append(piece)

    for batch in batches:
        for row in batch.to_pylist():
            if piece is None or piece["conv_id"] != row["conv_id"]:
                closed()
                piece = dict.fromkeys(fields, 0) | {"conv_id": row["conv_id"], "part": part, "codes": [], "first": None, "last": None}
                if len(done) >= HANDED:
                    yield pa.RecordBatch.from_pylist(done, kinds)
                    done = []
            n, turn = row["n"], row["turn"]
            initial = row["initial"] if row["initial"] in tuple(turn_alignment.INITIALS) else "o"
            gone = str(turn_alignment.INITIALS.index(initial))
            if row["blank"]:
                piece["blank"] += n
                piece["codes"].append(gone * n)
            else:
                stays = int(row["first"])
                piece["duplicate"] += n - stays
                piece["truncated"] += stays * row["cut"]
                piece["codes"].append((initial.upper() if row["cut"] else initial) * stays + gone * (n - stays))
            if turn is not None and turn != piece["last"]:
                piece["turns"] += 1
                piece["last"] = turn
                if piece["first"] is None:
                    piece["first"] = turn
    closed()
    if done:
        yield pa.RecordBatch.from_pylist(done, kinds)


def _report(pieces: list[dict]) -> tuple:
    """gaps, blank, duplicate, truncated, illegal, cost and audit of a conversation's pieces, which stand in order."""
    codes = "".join(p["codes"] for p in pieces)
    plain = codes.lower().translate(str.maketrans("0123", turn_alignment.INITIALS))
    illegal = sum(plain[i : i + 2] not in GAPLESS for i in range(len(plain) - 1))
    numbered = [p for p in pieces if p["first"] is not None]
    gaps = 0
    if numbered:
        # a number whose turns lie in two ranges is one number
        turns = sum(p["turns"] for p in numbered) - sum(a["last"] == b["first"] for a, b in zip(numbered, numbered[1:]))
        gaps = numbered[-1]["last"] - numbered[0]["first"] + 1 - turns
    return gaps, *(sum(p[c] for p in pieces) for c in ("blank", "duplicate", "truncated")), illegal, *turn_alignment.cheapest(codes)


def audits(known: DataFrame) -> DataFrame:
    """conv_id and `of`, a struct of counts, cost and audit, of every conversation."""
    names = [f.split()[0] for f in FOUND.split(", ")]
    kinds = [pa.string() if name == "audit" else pa.int64() for name in names]

    def computed(pieces: pa.Array) -> pa.Array:
        rows = [_report(p) for p in pieces.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    order = ["conv_id", "turn", "name"]
    pieces = _faults(known).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_pieces, PIECE)
    # at most one piece a range
    gathered = pieces.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct(*pieces.columns[1:]))).alias("pieces"))
    return gathered.select("conv_id", F.arrow_udf(computed, f"struct<{FOUND.replace(' ', ':').replace(',:', ',')}>")("pieces").alias("of"))


def _streamed(known: DataFrame, found: DataFrame) -> DataFrame:
    """Each conversation's audit and then its turns in order; conversations lie whole in a partition."""
    of = found.schema["of"].dataType.simpleString()
    nothing = {"turn": "long", "name": "string", "role": "string", "text": "string"}
    heads = found.select("conv_id", F.lit(0).alias("kind"), *[F.lit(None).cast(t).alias(c) for c, t in nothing.items()], "of")
    turns = known.select("conv_id", F.lit(1).alias("kind"), *nothing, F.lit(None).cast(of).alias("of"))
    return heads.unionByName(turns).repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "name")


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv_id, of, None, None) at the head of a conversation, then (edit, None, role, text) for all that stays or is put in."""
    audit, target, at, place = "", "", 0, 0

    def inserted() -> Iterator[tuple]:
        nonlocal at, place
        while at < len(audit) and audit[at] == "I":
            yield "I", None, ROLES[target[place]], ""
            at, place = at + 1, place + 1

    for batch in batches:
        for row in batch.to_pylist():
            if not row["kind"]:
                yield from inserted()
                audit, at, place = row["of"]["audit"], 0, 0
                target = turn_alignment.targets(audit)
                yield row["conv_id"], row["of"], None, None
                continue
            yield from inserted()
            edit = audit[at]
            at += 1
            if edit != "D":
                role = row["role"] if edit == "K" else ROLES[target[place]]
                place += 1
                yield edit, None, role, row["text"]
    yield from inserted()


def _digests(kinds: pa.Schema):
    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[dict] = []
        digest, empty = hashlib.sha256(), True
        for one, of, role, text in _repaired(batches):
            if of is not None:
                if done:
                    done[-1]["repaired_sha256"] = digest.hexdigest()
                if len(done) >= HANDED:
                    yield pa.RecordBatch.from_pylist(done, kinds)
                    done = []
                done.append({"conv_id": one, **of})
                digest, empty = hashlib.sha256(), True
                continue
            digest.update((("" if empty else "\n") + f"{role}:{text}").encode())
            empty = False
        if done:
            done[-1]["repaired_sha256"] = digest.hexdigest()
            yield pa.RecordBatch.from_pylist(done, kinds)

    return digests


def report(rows: DataFrame) -> DataFrame:
    """conv_id, counts of faults, cost, audit and digest of the repaired turns, for each conversation of (conv_id, turn, role, text)."""
    known = _known(rows)
    schema = f"conv_id long, {FOUND}, repaired_sha256 string"
    kinds = pa.schema([(f.split()[0], pa.string() if f.endswith("string") else pa.int64()) for f in schema.split(", ")])
    return _streamed(known, audits(known)).mapInArrow(_digests(kinds), schema)


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())])
    held: list[dict] = []
    conv_id, turn, size = None, 0, 0
    for one, of, role, text in _repaired(batches):
        if of is not None:
            conv_id, turn = one, 0
            continue
        held.append({"conv_id": conv_id, "turn": turn, "role": role, "text": text, "edit": one})
        turn, size = turn + 1, size + len(text)
        if len(held) >= HANDED or size >= 1 << 20:
            yield pa.RecordBatch.from_pylist(held, kinds)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, kinds)


def repaired(rows: DataFrame) -> DataFrame:
    """conv_id, turn (from 0), role, text and edit (K, R, I) of the repaired conversations."""
    known = _known(rows)
    return _streamed(known, audits(known)).mapInArrow(_listed, "conv_id long, turn long, role string, text string, edit string")


def with_all(found: DataFrame, conversations: DataFrame) -> DataFrame:
    """The report with a row for every conv_id of `conversations`; those without turns have nothing to report."""
    nothing = {f.split()[0]: F.lit("") if f.endswith("string") else F.lit(0) for f in FOUND.split(", ")}
    nothing["repaired_sha256"] = F.sha2(F.lit(""), 256)
    own = conversations.select(F.col("conv_id").cast("long").alias("c")).distinct()
    joined = own.join(found, F.equal_null("c", "conv_id"), "left")
    return joined.select(F.col("c").alias("conv_id"), *[F.coalesce(n, v).alias(n) for n, v in nothing.items()])


def damaged(rows: DataFrame) -> DataFrame:
    """Turns with faults by checksum of id and number: dropped, emptied, without sentence ends, repeated, or of role user."""

    def or_space(column: str) -> Column:
        return F.coalesce(F.col(column).cast("string"), F.lit(" "))

    number = F.crc32(F.encode(F.concat(or_space("conv_id"), F.lit(":"), or_space("turn")), "UTF-8")) % 20
    role, text = or_space("role"), or_space("text")
    text = F.when(number == 1, "").when(number == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    copies = F.when(number == 0, 0).when(number == 3, 2).otherwise(1)
    return rows.select(
        "conv_id",
        "turn",
        F.when(number == 4, "user").otherwise(role).alias("role"),
        text.alias("text"),
        F.explode(F.array_repeat(F.lit(0), copies)).alias("copy"),
    ).drop("copy")
