import hashlib
import itertools
import random
import re
import zlib

import pytest

from twinseek.llm import conversation_repair as cr
from twinseek.llm import queries
from twinseek.llm import turn_alignment as ta

COLUMNS = "conv_id long, turn long, role string, text string, kind int, name int, n int, part int, codes int"
BLANK = "[^\x20\x09-\x0d]"


def enumerated(codes):
    """Least (cost, audit) over all edits with up to four insertions."""
    found = []

    def go(i, roles, cost, audit):
        if i == len(codes) and re.fullmatch("(s?(ua)+)?", roles):
            found.append((cost, audit))
        if audit.count("I") < 4:
            for role in "ua":
                go(i, roles + role, cost + 2, audit + "I")
        if i < len(codes):
            go(i + 1, roles, cost + 3, audit + "D")
            if not codes[i].isdigit():
                cut = int(codes[i].isupper())
                go(i + 1, roles + codes[i].lower(), cost + cut, audit + "K")
                for role in "ua":
                    go(i + 1, roles + role, cost + 2 + cut, audit + "R")

    go(0, "", 0, "")
    return min(found)


def walked(codes):
    """Least (cost, audit) by what may come next, turn by turn."""
    far = (1 << 30, "")
    state = {"s": (0, ""), "u": far, "a": far, "f": far}

    def step(k, cost, edit):
        return state[k][0] + cost, state[k][1] + edit

    def insert():
        state["a"] = min(state["a"], *(step(k, 2, "I") for k in "suf"))
        state["u"] = min(state["u"], step("a", 2, "I"))

    for code in codes:
        insert()
        new = {k: step(k, 3, "D") for k in state}
        if not code.isdigit():
            cut, x = int(code.isupper()), code.lower()
            for k in "suf":
                new["a"] = min(new["a"], step(k, cut + 2 * (x != "u"), "K" if x == "u" else "R"))
            new["u"] = min(new["u"], step("a", cut + 2 * (x != "a"), "K" if x == "a" else "R"))
            if x == "s":
                new["f"] = min(new["f"], step("s", cut, "K"))
        state = new
    insert()
    return min(state["s"], state["u"])


def test_alignment_against_all_edits():
    random.seed(2)
    shorts = ["".join(c) for n in range(3) for c in itertools.product("suaoSUAO0", repeat=n)]
    longer = ["".join(random.choice("suaoSUAO01") for _ in range(3)) for _ in range(80)]
    for codes in shorts + longer:
        assert ta.cheapest(codes) == enumerated(codes) == walked(codes), codes


@pytest.mark.parametrize("segment", [1, 2, 5, 64])
def test_segments(monkeypatch, segment):
    monkeypatch.setattr(ta, "SEGMENT", segment)
    random.seed(segment)
    for _ in range(400):
        codes = "".join(random.choice("suauauaoSUAO01") for _ in range(random.randint(0, 16)))
        assert ta._cheapest(codes) == walked(codes), codes


def test_a_long_conversation():
    random.seed(9)
    codes = "".join("ua"[i % 2] if random.random() < 0.8 else random.choice("suaoSUAO01") for i in range(5000))
    assert ta.cheapest(codes) == walked(codes)


def name_of(role, text):
    return hashlib.md5(f"{len(role)}:{role}:{text}".encode()).hexdigest()


def brute(rows, damage=True):
    def shown(x):
        return " " if x is None else str(x)

    after = {}
    for conv, turn, role, text in rows:
        kept = after.setdefault(conv, [])
        number = zlib.crc32(f"{shown(conv)}:{shown(turn)}".encode()) % 20 if damage else 9
        role, text = shown(role), shown(text)
        text = "" if number == 1 else re.sub("[.!?]", "", text) if number == 2 else text
        role = "user" if number == 4 else role
        kept += [(turn, role, text)] * {0: 0, 3: 2}.get(number, 1)
    found = {}
    for conv, turns in after.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, name_of(t[1], t[2])))
        seen, codes, counts = set(), "", {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, role, text in turns:
            initial = role[:1] if role[:1] in ("s", "u", "a") else "o"
            solid = re.findall(BLANK, text)
            fault = (
                "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else ""
            )
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            codes += "0" if fault in ("blank", "duplicate") else initial.upper() if fault else initial
        cost, audit = walked(codes)
        left = len(audit) - audit.count("D")
        target = iter("s" * (left % 2) + "ua" * (left // 2))
        said, place = [], 0
        for edit in audit:
            symbol = next(target) if edit != "D" else ""
            if edit == "I":
                said.append({"u": "user:", "a": "assistant:"}[symbol])
                continue
            _, role, text = turns[place]
            place += 1
            if edit == "K":
                said.append(f"{role}:{text}")
            elif edit == "R":
                said.append({"u": "user:", "a": "assistant:"}[symbol] + text)
        numbers = {t[0] for t in turns if t[0] is not None}
        initials = [t[1][:1] for t in turns]
        found[conv] = {
            "gaps": max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0,
            **counts,
            "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
            "cost": cost,
            "audit": audit,
            "repaired_sha256": hashlib.sha256("\n".join(said).encode()).hexdigest(),
        }
    return found


def made():
    random.seed(4)
    texts = ["Well. ", "cut off", "so?\n\t", "", " \n", "ja!", "über 漢字.", "x" * 3000 + ".", "same.", "\x1f"]
    rows = []
    for conv in range(60):
        for turn in range(random.randint(1, 9)):
            role = "system" if not turn and conv % 3 == 0 else ["user", "assistant"][turn % 2]
            rows.append((conv, turn * 2 + conv, role, random.choice(texts) if random.random() < 0.4 else f"text {conv} {turn}."))
    rows += [(None, 1, "user", "a."), (None, None, "assistant", "b."), (None, 3, None, None), (70, None, "tool", "c."), (70, None, "", "d.")]
    rows += [(71, 5, "user", "one."), (71, 5, "assistant", "two."), (71, 5, "user", "one."), (71, -3, "Super", "z"), (72, 1, "user", " ")]
    # one conversation with many more turns than the others, and one of which nothing stays
    rows += [(80, i % 700, ["user", "assistant"][i % 2], f"long {i % 900}." if i % 7 else "cut") for i in range(1500)]
    dropped = next(c for c in range(100, 999) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows.append((dropped, 0, "user", "gone."))
    rows += [rows[3], rows[3]]
    return rows


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, 4, 5) for r in rows], COLUMNS)


def test_query_against_brute_force(spark, tmp_path):
    rows = made()
    table(spark, rows).repartition(4).write.parquet(f"{tmp_path}/conversations.parquet")
    found = queries.REGISTRY["op12_conversation_repair"](spark, str(tmp_path)).collect()
    assert len(found) == len({r[0] for r in rows})
    expected = brute(rows)
    for row in found:
        own = row.asDict()
        assert {k: v for k, v in own.items() if k != "conv_id"} == expected.get(own["conv_id"]), own["conv_id"]


def test_conversation_cut_by_many_ranges(spark, monkeypatch):
    rows = [r for r in made() if r[0] in (3, 80)]
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = {r["conv_id"]: r.asDict() for r in cr.report(table(spark, rows)).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    for conv, own in brute(rows, damage=False).items():
        assert {k: found[conv][k] for k in own} == own


def test_repaired_rows(spark):
    rows = [(1, 0, "assistant", "hi."), (1, 1, "user", "a."), (1, 2, "assistant", "b."), (2, 1, "user", "")]
    rows += [(3, 1, "tool", "x."), (3, 2, "assistant", "y.")]
    found = cr.repaired(table(spark, rows)).orderBy("conv_id", "turn").collect()
    assert [tuple(r) for r in found] == [
        (1, 0, "user", "", "I"),
        (1, 1, "assistant", "hi.", "K"),
        (1, 2, "user", "a.", "K"),
        (1, 3, "assistant", "b.", "K"),
        (3, 0, "user", "x.", "R"),
        (3, 1, "assistant", "y.", "K"),
    ]


def test_empty_table(spark, tmp_path):
    table(spark, made()[:1]).limit(0).write.parquet(f"{tmp_path}/conversations.parquet")
    assert queries.REGISTRY["op12_conversation_repair"](spark, str(tmp_path)).collect() == []
