"""Byte-pair encoding by backtracking over longest token matches, and decoding by an offset table.

An Aho-Corasick automaton of all tokens finds the longest token at every byte of a piece. Tokens are laid left to right; a token
may follow another only if merging their joined bytes would leave them apart (the pair-compatibility check, answered from a
table of pairs seen so far). Where no prefix of the longest token fits, the last token is taken back and shortened. Every byte
is left at most once, so the time is linear, and the result is exactly that of merging by rank.

Texts are cut as the vocabulary's byte-level pre-tokeniser cuts them. Pieces are encoded independently, so their ids are kept in
a bounded table per worker.

Defined cases: a null text is the empty text and has no ids; strings of special tokens become their id, as the library does.
Decoding is exact for any ids in the vocabulary; bytes that are not UTF-8 become replacement characters.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# The cut of byte-level vocabularies of this family.
CUT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Characters below this one are cut by a plain pattern with the same classes spelled out, which is faster.
PLAIN = 0x250
# Kept ids of pieces, per worker: number of pieces, and the longest kept.
KEPT_PIECES, KEPT_LENGTH = 800_000, 40
KEPT_PAIRS = 600_000


@dataclass
class Vocabulary:
    """Token bytes by id, merge order by id (-1: a single byte), parts of merged tokens, special strings."""

    tokens: tuple[bytes, ...]
    order: tuple[int, ...]
    parts: tuple[tuple[int, int], ...]
    special: dict[str, int]
    made: dict[str, object] = field(default_factory=dict)

    def encoder(self) -> Encoder:
        """The encoder of this worker; a broadcast value stays in the worker, and so do the tables, from task to task."""
        if "encoder" not in self.made:
            self.made["encoder"] = Encoder(self)
        return self.made["encoder"]

    def decoder(self) -> Decoder:
        if "decoder" not in self.made:
            self.made["decoder"] = Decoder(self)
        return self.made["decoder"]


def byte_letters() -> dict[str, int]:
    """Byte-level vocabularies print each byte as a letter: printable ones as themselves, the others from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def load(path: str) -> Vocabulary:
    """Read a byte-level vocabulary file on the driver; its size is that of the vocabulary, whatever the corpus."""
    with open(path, encoding="utf-8") as file:
        content = json.load(file)
    letters = byte_letters()
    ids = content["model"]["vocab"]
    special = {t["content"]: t["id"] for t in content.get("added_tokens", [])}
    size = 1 + max([*ids.values(), *special.values()])
    tokens: list[bytes] = [b""] * size
    for text, number in ids.items():
        tokens[number] = bytes(letters[c] for c in text)
    order, parts = [-1] * size, [(-1, -1)] * size
    for rank, pair in enumerate(content["model"]["merges"]):
        left, right = pair if isinstance(pair, list) else pair.split(" ")
        number = ids[left + right]
        if order[number] < 0 and len(tokens[number]) > 1:
            order[number], parts[number] = rank, (ids[left], ids[right])
    for text, number in special.items():
        tokens[number] = text.encode()
    return Vocabulary(tuple(tokens), tuple(order), tuple(parts), special)


def plain_cut() -> str:
    """The cut for texts of characters below PLAIN, with the classes for letters, numbers and white space spelled out."""
    kinds = {"L": "", "N": "", "Z": r"\t-\r\x85"}
    for c in map(chr, range(PLAIN)):
        kind = unicodedata.category(c)[0]
        if kind in kinds:
            kinds[kind] += re.escape(c)
    marks = f"[^{kinds['Z']}{kinds['L']}{kinds['N']}]+"
    pieces = CUT.replace(r"[^\s\p{L}\p{N}]+", marks)
    for name, letters in ((r"\p{L}", kinds["L"]), (r"\p{N}", kinds["N"]), (r"\s", kinds["Z"])):
        pieces = pieces.replace(name, f"[{letters}]")
    return pieces.replace(r"\S", f"[^{kinds['Z']}]")


class Encoder:
    """Encodes texts with one vocabulary. Built once per task."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.automaton = ahocorasick.Automaton()
        self.plain = {}
        special = set(vocabulary.special.values())
        for number, token in enumerate(vocabulary.tokens):
            if token and number not in special:
                self.plain[token] = number
                self.automaton.add_word(token.decode("latin-1"), number)
        self.automaton.make_automaton()
        self.joins = {
            pair: order
            for pair, order in zip(vocabulary.parts, vocabulary.order, strict=True)
            if order >= 0
        }
        self.shorter: dict[int, int] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.pieces: dict[str, bytes] = {}
        self.sizes = list(map(len, vocabulary.tokens))
        self.cut = regex.compile(CUT).findall
        self.plain_cut = re.compile(plain_cut()).findall
        self.foreign = re.compile(f"[^\\0-{chr(PLAIN - 1)}]").search
        names = sorted(vocabulary.special, key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None

    def prefix(self, token: int) -> int:
        """The longest token that begins the given one and is shorter; -1 if there is none."""
        found = self.shorter.get(token)
        if found is None:
            data = self.v.tokens[token]
            found = next((self.plain[data[:n]] for n in range(len(data) - 1, 0, -1) if data[:n] in self.plain), -1)
            self.shorter[token] = found
        return found

    def apart(self, left: int, right: int) -> bool:
        """Whether merging the joined bytes of two tokens by rank gives just these two."""
        found = self.pairs.get((left, right))
        if found is None:
            if len(self.pairs) > KEPT_PAIRS:
                self.pairs.clear()
            found = self.pairs[left, right] = self._apart(left, right)
        return found

    def _apart(self, left: int, right: int) -> bool:
        # Undo merges from the last one back. At each moment the tokens that touch at the seam are (left, right); a merge
        # across the seam would have happened then if it comes before the merge undone last (on the right: or is that same
        # rule, as the seam lies further left).
        order, parts = self.v.order, self.v.parts
        limit = 1 << 60
        while True:
            across = self.joins.get((left, right), 1 << 60)
            if across < limit:
                return False
            a, b = order[left], order[right]
            if a < 0 and b < 0:
                return True
            if a > b:
                limit, left = a, parts[left][1]
            else:
                limit, right = b + 1, parts[right][0]

    def piece(self, data: bytes) -> list[int]:
        """Ids of one piece of the cut."""
        text = data.decode("latin-1")
        longest: dict[int, int] = {}
        sizes, apart, pairs = self.sizes, self.apart, self.pairs.get

        def ahead(at: int) -> int:
            """The longest token at a byte; the automaton runs on from there until it meets bytes already known."""
            if at not in longest:
                for end, number in self.automaton.iter_long(text, at):
                    begin = end + 1 - sizes[number]
                    if begin in longest:
                        break
                    longest[begin] = number
            return longest[at]

        n = len(data)
        out: list[int] = []
        closed: set[int] = set()
        at = 0
        token = ahead(0) if n else -1
        while at < n:
            last = out[-1] if out else -1
            while True:
                end = at + sizes[token]
                if end not in closed and (last < 0 or (pairs((last, token)) or apart(last, token))):
                    out.append(token)
                    at = end
                    token = ahead(at) if at < n else -1
                    break
                token = self.prefix(token)
                if token < 0:
                    closed.add(at)
                    token = out.pop()
                    at -= sizes[token]
                    break
        return out

    def kept_piece(self, text: str) -> bytes:
        found = array("I", self.piece(text.encode())).tobytes()
        if len(text) <= KEPT_LENGTH:
            if len(self.pieces) >= KEPT_PIECES:
                self.pieces.clear()
            self.pieces[text] = found
        return found

    def part(self, text: str) -> bytes:
        cut = self.cut if self.foreign(text) else self.plain_cut
        return b"".join([self.pieces.get(p) or self.kept_piece(p) for p in cut(text)])

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers."""
        parts = self.special.split(text) if self.special else [text]
        return b"".join(
            array("I", [self.v.special[part]]).tobytes() if i % 2 else self.part(part) for i, part in enumerate(parts)
        )


class Decoder:
    """Token bytes in one array with the offset of each token."""

    def __init__(self, vocabulary: Vocabulary):
        self.data = np.frombuffer(b"".join(vocabulary.tokens), np.uint8)
        self.offsets = np.cumsum([0, *map(len, vocabulary.tokens)])

    def decode(self, ids: bytes) -> bytes:
        numbers = np.frombuffer(ids, "<u4")
        starts, sizes = self.offsets[numbers], self.offsets[numbers + 1] - self.offsets[numbers]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        return self.data[np.arange(total) + np.repeat(starts - ends + sizes, sizes)].tobytes()


def shipped(spark: SparkSession, path: str) -> Broadcast:
    """The vocabulary for all tasks. A vocabulary file is bounded (about 50,000 tokens), so it may be broadcast."""
    return spark.sparkContext.broadcast(load(path))


def encoded(vocabulary: Broadcast, text: Column) -> Column:
    """Ids of a text as binary: little-endian unsigned 32-bit numbers."""

    def encode(texts: pa.Array) -> pa.Array:
        encoder = vocabulary.value.encoder()
        return pa.array([encoder.encode(t or "") for t in texts.to_pylist()], pa.binary())

    return F.arrow_udf(encode, "binary")(text)


def decoded(vocabulary: Broadcast, ids: Column) -> Column:
    """The text of ids given as binary."""

    def decode(column: pa.Array) -> pa.Array:
        decoder = vocabulary.value.decoder()
        return pa.array([decoder.decode(i or b"").decode("utf-8", "replace") for i in column.to_pylist()], pa.string())

    return F.arrow_udf(decode, "string")(ids)


def as_numbers(ids: Column) -> Column:
    """Binary ids as an array of numbers."""

    def numbers(column: pa.Array) -> pa.Array:
        lists = [np.frombuffer(i or b"", "<u4").astype(np.int32) for i in column.to_pylist()]
        return pa.array(lists, pa.list_(pa.int32()))

    return F.arrow_udf(numbers, "array<int>")(ids)
