"""Wagner-Fischer alignment of a conversation's turns to its alternating target strings.

Turns come as one character each: `s u a o` by the initial of their role (o: any other), in capitals where the text is cut off, and
`0 1 2 3` in the same order for turns that must go. Targets are the strings of `(s?(ua)+)?`; a length has one target at most.
Edits and what they cost: Delete 3, Insert 2, Keep 0, Rerole 2, one more for a turn cut off that stays.

Targets of all lengths share their ends, so one table holds the cost of aligning the turns from any place on with the last r symbols.
Its bands are Ukkonen's: with a repair of known cost at hand (the incumbent, a walk from left to right), a cell is needed only if the turns
and symbols left differ in number by no more than the incumbent can pay for in insertions or deletions. Every length whose cost is the
least is traced back, and the least audit in ASCII order wins.

A long conversation is cut into segments. Between two of them only what may come next matters: `start`, `u`, `a`, or `f` for a u that must
come, after the s. Costs of all that may come next go backwards over the segments, audits forwards, so time and memory per turn do
not grow with the conversation. Insertions at a cut belong to the segment after it, which keeps the audits of tied paths comparable.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

DELETE, INSERT, REROLE = 3, 2, 2
SEGMENT = 1024
# What ending a segment with another symbol, or entering it with another one, can cost at most.
SLACK = 10
INFINITE = 1 << 29
INITIALS = "suao"
REMEMBERED = 1 << 16


def incumbent(codes: str, last: bool) -> int:
    """Cost of a repair found from left to right: insert what is missing, delete what fits nowhere."""
    cost, expected = 0, "u"
    for code in codes:
        initial = code.lower()
        if code.isdigit() or initial not in "ua":
            cost += DELETE
            continue
        cost += code.isupper()
        if initial == expected:
            expected = "a" if initial == "u" else "u"
        else:
            cost += INSERT
    return cost + (INSERT if last and expected == "a" else 0)


class Segment:
    """Tables of a run of turns for each symbol that may come after it."""

    def __init__(self, codes: str, last: bool, whole: bool):
        self.codes, self.last = codes, last
        m = len(codes)
        forced = [c.isdigit() for c in codes]
        spare = incumbent(codes, last) + (0 if whole else SLACK) - DELETE * sum(forced)
        # one more each way: the s is a symbol besides the r that are counted
        self.below, self.above = spare // DELETE + 1, spare // INSERT + 1
        self.left = np.concatenate([np.cumsum([not f for f in forced[::-1]], dtype=np.int64)[::-1], [0]])
        width = self.below + self.above + 1
        steps = np.arange(width, dtype=np.int32)
        insertions = INSERT * steps
        self.tables, self.behind_s = {}, {}
        for end in ("u",) if last else ("u", "a"):
            table = np.full((m + 1, width), INFINITE, np.int32)
            with_s = np.full((m + 1, width), INFINITE, np.int32)
            symbols = steps - self.below
            table[m][symbols >= 0 if last else symbols == 0] = 0
            if last:
                table[m] += INSERT * np.maximum(symbols, 0)
            for i in range(m - 1, -1, -1):
                row, code = table[i], codes[i]
                symbols = steps + self.left[i] - self.below
                if forced[i]:
                    row[:] = table[i + 1] + DELETE
                    with_s[i] = with_s[i + 1] + DELETE
                else:
                    initial, cut = code.lower(), int(code.isupper())
                    # the last symbol is an a if u comes next
                    is_a = symbols % 2 == (1 if end == "u" else 0)
                    same = is_a if initial == "a" else ~is_a if initial == "u" else np.zeros(width, bool)
                    row[:] = table[i + 1] + np.where(same, 0, REROLE).astype(np.int32) + cut
                    row[symbols <= 0] = INFINITE
                    np.minimum(row[:-1], table[i + 1][1:] + DELETE, out=row[:-1])
                    with_s[i, :-1] = with_s[i + 1, 1:] + DELETE
                    if initial == "s":
                        np.minimum(with_s[i, :-1], table[i + 1][1:] + cut, out=with_s[i, :-1])
                row[symbols < 0] = INFINITE
                np.minimum(row, np.minimum.accumulate(row - insertions) + insertions, out=row)
                np.minimum(row, INFINITE, out=row)
                np.minimum(with_s[i], INFINITE, out=with_s[i])
            self.tables[end], self.behind_s[end] = table, with_s

    def options(self, entry: str, costs: dict[str, int]) -> list[tuple[int, str, int, bool, str]]:
        """Cost, end, symbols, whether the s comes first, and what may come next, of every target from `entry`."""
        symbols = np.arange(self.below + self.above + 1) + self.left[0] - self.below
        found = [(DELETE * len(self.codes) + costs[entry], "u", 0, False, entry)]
        for end, table in self.tables.items():
            odd = (entry == "a") != (end == "a")
            fits = (symbols % 2 == int(odd)) & (symbols >= 0)
            for with_s in (False, True) if entry == "start" else (False,):
                values = (self.behind_s[end] if with_s else table)[0]
                for at in np.flatnonzero(fits & (values < INFINITE)):
                    r = int(symbols[at])
                    after = end if r else "f"
                    if r or with_s:
                        found.append((int(values[at]) + costs[after], end, r, with_s, after))
        return found

    def least(self, entry: str, costs: dict[str, int]) -> int:
        return min(INFINITE, min(option[0] for option in self.options(entry, costs)))

    def audit(self, entry: str, costs: dict[str, int]) -> tuple[str, str]:
        """The least of the backtraced audits of all cheapest targets, and what may come next after it."""
        options = self.options(entry, costs)
        least = min(option[0] for option in options)
        return min((self.traced(end, r, with_s), after) for cost, end, r, with_s, after in options if cost == least)

    def traced(self, end: str, r: int, with_s: bool) -> str:
        table, behind_s = self.tables[end], self.behind_s[end]

        def of(rows: np.ndarray, i: int, r: int) -> int:
            at = r - int(self.left[i]) + self.below
            return int(rows[i, at]) if 0 <= at < rows.shape[1] and r >= 0 else INFINITE

        out, i, m = [], 0, len(self.codes)
        if not r and not with_s:
            return "D" * m
        while i < m or r:
            value = of(behind_s if with_s else table, i, r)
            if i < m and value == DELETE + of(behind_s if with_s else table, i + 1, r):
                out.append("D")
                i += 1
            elif with_s:
                out.append("K")
                i, with_s = i + 1, False
            elif r and value == INSERT + of(table, i, r - 1):
                out.append("I")
                r -= 1
            else:
                symbol = "a" if r % 2 == (1 if end == "u" else 0) else "u"
                out.append("K" if self.codes[i].lower() == symbol else "R")
                i, r = i + 1, r - 1
        return "".join(out)


@lru_cache(REMEMBERED)
def _short(codes: str) -> tuple[int, str]:
    return _cheapest(codes)


def _cheapest(codes: str) -> tuple[int, str]:
    parts = [codes[i : i + SEGMENT] for i in range(0, len(codes), SEGMENT)] or [""]
    costs = [{"start": 0, "u": 0, "a": INFINITE, "f": INFINITE}]
    for at in range(len(parts) - 1, 0, -1):
        segment = Segment(parts[at], at == len(parts) - 1, whole=False)
        costs.append({entry: segment.least(entry, costs[-1]) for entry in costs[-1]})
    costs.reverse()
    audits, entry, total = [], "start", 0
    for at, part in enumerate(parts):
        segment = Segment(part, at == len(parts) - 1, whole=len(parts) == 1)
        if not at:
            total = segment.least(entry, costs[0])
        audit, entry = segment.audit(entry, costs[at])
        audits.append(audit)
    return total, "".join(audits)


def cheapest(codes: str) -> tuple[int, str]:
    """Least cost of a repair, and the least audit of those that cost as much."""
    return _short(codes) if len(codes) <= 64 else _cheapest(codes)


def targets(audit: str) -> str:
    """The target string that an audit leads to."""
    n = len(audit) - audit.count("D")
    return "s" * (n % 2) + "ua" * (n // 2)
