"""The best matches of keyword queries, ranked where the chunks lie: phrases, exclusions and cover density for whole batches of pairs.

The same rules as `fulltext.match_groups` and `fulltext.cover_density`, which work them out row by row. A running list holds the best k
of every group; its last relevance bounds what is still looked at closely: a group of m words of which the rarest occurs n times has m x n
minimal intervals at most (each begins with another word, or lies behind another occurrence of the rarest), and no more than there
are occurrences after the first of each item.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from twinseek.functions.fulltext import SCORE_DECIMALS, WORD_WEIGHT
from twinseek.operators.candidates import Asked, places, plain

# Words of pairs, and cells of interval tables, that are looked at together.
WORDS, CELLS = 1 << 20, 1 << 21
# Matches that a task holds back, rows and bytes, and bytes of the bounds it keeps.
HELD_ROWS, HELD_BYTES, BOUND_BYTES = 1 << 20, 64 << 20, 64 << 20
STEP = 1 << 16
UNIT = 10**SCORE_DECIMALS
NO_BOUND = -1


def item_columns() -> list[Column]:
    """A compiled query as flat lists: words and their offsets; size, group and sign of each item; number of groups and required words."""

    def items(group: Column, number: Column) -> Column:
        def side(name: str) -> Column:
            return F.transform(group[name], lambda x: F.struct(number.alias("g"), F.lit(name == "must_not").alias("n"), x.alias("w")))

        return F.concat(side("must"), side("must_not"))

    found = F.flatten(F.transform("query", items))
    words = lambda value: F.flatten(F.transform(found, lambda x: F.transform(x["w"], lambda w: value(w, F.element_at(x["w"], 1)))))
    return [
        words(lambda w, head: w["lex"]).alias("lexemes"),
        words(lambda w, head: w["off"] - head["off"]).alias("offsets"),
        F.transform(found, lambda x: F.size(x["w"])).alias("sizes"),
        F.transform(found, lambda x: x["g"]).alias("groups"),
        F.transform(found, lambda x: x["n"].cast("int")).alias("excluded"),
        F.size("query").alias("n_groups"),
        (F.col("group_no") - 1).alias("own"),
        F.size("required").alias("n_required"),
    ]


def rounded(raw: np.ndarray) -> np.ndarray:
    """Relevance in units of its last decimal, halves rounded up as Spark does."""
    scaled = raw * UNIT
    code = np.rint(scaled).astype(np.int64)
    # a value that nearly lies between two is settled by its digits
    for i in np.flatnonzero(np.abs(np.abs(scaled - code) - 0.5) < 1e-3):
        code[i] = int(Decimal(repr(float(raw[i]))).scaleb(SCORE_DECIMALS).quantize(Decimal(1), ROUND_HALF_UP))
    return code


def _starts(counts: np.ndarray) -> np.ndarray:
    return np.r_[0, np.cumsum(counts)].astype(np.int64)


def _parts(weights: np.ndarray, bound: int) -> list[np.ndarray]:
    """Numbers of items in runs of bounded weight."""
    cuts = np.flatnonzero(np.diff(np.cumsum(weights) // bound)) + 1
    return [p for p in np.split(np.arange(len(weights)), cuts) if len(p)]


class Ranked(Asked):
    """Query groups with the running best of their matches."""

    def __init__(self, leads: pa.Table, best: int):
        super().__init__(leads)
        self.best = best
        flat = {c: plain(leads[c]).flatten().to_numpy().astype(np.int64) for c in ("offsets", "sizes", "groups", "excluded")}
        self.offset, self.sizes, self.groups, self.excluded = flat["offsets"], flat["sizes"], flat["groups"], flat["excluded"] > 0
        self.items = _starts(np.asarray(plain(leads["sizes"]).value_lengths()))
        self.n_groups, self.own, self.n_required = (leads[c].to_numpy().astype(np.int64) for c in ("n_groups", "own", "n_required"))
        self.alikes: dict[str, int] = {}
        # relevance and id of the last of the best, by kind of chunk and by group; the last kind has no bound
        self.kth = np.full((1, len(self.leads)), NO_BOUND, np.int64)
        self.kth_id = np.zeros((1, len(self.leads)), np.int64)
        self.held: list[pa.Table] = []
        self.n_held = self.n_new = 0

    def best_of(self, tables: Iterator[pa.Table]) -> Iterator[pa.RecordBatch]:
        """The best matches among all chunks; what is held back is bounded, so a group may return more than it needs."""
        for rows in tables:
            self._add(rows)
            if sum(t.nbytes for t in self.held) > HELD_BYTES or self.n_held > HELD_ROWS:
                self._settle()
                if sum(t.nbytes for t in self.held) > HELD_BYTES // 2 or self.n_held > HELD_ROWS // 2:
                    yield from self._out()
        self._settle()
        yield from self._out()

    def _out(self) -> Iterator[pa.RecordBatch]:
        for t in self.held:
            lead = pa.array(self.leads[t["lead"].to_numpy()], pa.int64())
            yield from t.drop_columns(["kind", "code"]).set_column(0, "lead", lead).combine_chunks().to_batches()
        self.held, self.n_held, self.n_new = [], 0, 0

    def _add(self, rows: pa.Table) -> None:
        entries = plain(rows["text_search_vector"]).flatten()
        lists = entries.field("positions")
        self.n_positions = np.asarray(lists.value_lengths().fill_null(0), dtype=np.int64)
        self.first_position = _starts(self.n_positions)
        self.positions = np.asarray(lists.flatten()).astype(np.int64)
        self.spread = int(self.positions.max(initial=0) + self.offset.max(initial=0)) + 2
        self.places_known = None
        names = plain(rows["alike"]).dictionary_encode(null_encoding="encode")
        codes = np.array([self.alikes.setdefault(x, len(self.alikes)) for x in names.dictionary.to_pylist()], dtype=np.int64)
        self.kind = codes[names.indices.to_numpy()]
        ids = plain(rows["id"])
        comparable = pa.types.is_integer(ids.type) and not ids.null_count
        self.ids = ids.to_numpy().astype(np.int64) if comparable else None
        carried = rows.drop_columns(["scope", "text_search_vector"])
        for leads, chunks in self.pairs(rows, entries):
            for part in _parts(self.start[leads + 1] - self.start[leads], WORDS):
                lead, row, raw = self._matches(leads[part], chunks[part])
                if not len(lead):
                    continue
                found = carried.take(pa.array(row)).add_column(0, "lead", pa.array(lead, pa.int64()))
                found = found.append_column("raw", pa.array(raw, pa.float64()))
                found = found.append_column("kind", pa.array(self.kind[row])).append_column("code", pa.array(rounded(raw)))
                self.held.append(found)
                self.n_held, self.n_new = self.n_held + len(lead), self.n_new + len(lead)
                if self.n_new > max(STEP, self.n_held - self.n_new):
                    self._settle()

    def _settle(self) -> None:
        """Keep the best of what is held, and note the last of them."""
        if not self.n_new:
            return
        table = pa.concat_tables(self.held).combine_chunks()
        lead, kind, code = (table[c].to_numpy() for c in ("lead", "kind", "code"))
        ids = pc.rank(plain(table["id"]), sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy()
        order = np.lexsort((ids, -code, kind, lead))
        new = np.r_[True, (lead[order][1:] != lead[order][:-1]) | (kind[order][1:] != kind[order][:-1])]
        place = places(np.r_[np.flatnonzero(new), len(order)])
        last = order[place == self.best - 1]
        if self.ids is not None and len(last):
            fits = max(1, BOUND_BYTES // (16 * len(self.leads)))
            if len(self.kth) <= min(len(self.alikes), fits):
                more = min(len(self.alikes), fits) + 1 - len(self.kth)
                self.kth = np.r_[self.kth[:-1], np.full((more + 1, len(self.leads)), NO_BOUND, np.int64)]
                self.kth_id = np.r_[self.kth_id[:-1], np.zeros((more + 1, len(self.leads)), np.int64)]
            last = last[kind[last] < len(self.kth) - 1]
            at = kind[last], lead[last]
            id_ = plain(table["id"]).fill_null(0).to_numpy().astype(np.int64)[last]
            better = (code[last] > self.kth[at]) | ((code[last] == self.kth[at]) & (id_ < self.kth_id[at]))
            at = at[0][better], at[1][better]
            self.kth[at], self.kth_id[at] = code[last][better], id_[better]
        table = table.take(pa.array(np.sort(order[place < self.best])))
        self.held, self.n_held, self.n_new = [table], table.num_rows, 0

    def _matches(self, lead: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs that match by this group first and may be among the best, with their relevance."""
        n_words = self.start[lead + 1] - self.start[lead]
        pair = np.repeat(np.arange(len(lead)), n_words)
        word = self.start[lead[pair]] + places(_starts(n_words))
        line = self.find(self.mentioned[word], row[pair])
        entry = np.where(line >= 0, self.entry[line], 0)
        count = np.where(line >= 0, self.n_positions[entry], 0)
        n_items = np.diff(self.items)[lead]
        owner = np.repeat(np.arange(len(lead)), n_items)
        item = self.items[lead[owner]] + places(_starts(n_items))
        size = self.sizes[item]
        head = _starts(size)[:-1]
        width = self.offset[word[head + size - 1]]
        occurs, begin = count[head], self.first_position[entry[head]]
        source = self.positions
        if (size > 1).any():
            whole = np.flatnonzero((size > 1) & (np.minimum.reduceat(count, head) > 0))
            occurs[size > 1] = 0
            at, kept = self._phrases(head[whole], size[whole], word, entry)
            occurs[whole] = np.bincount(at, minlength=len(whole))
            begin[whole] = len(source) + _starts(occurs[whole])[:-1]
            source = np.r_[source, kept]
        # groups of a pair that hold, of which the first one reports it
        group = _starts(self.n_groups[lead])
        of_group = group[owner] + self.groups[item]
        fails = np.where(self.excluded[item], occurs > 0, occurs == 0)
        failed = np.bincount(of_group, weights=fails, minlength=group[-1]) > 0
        number = places(group)
        first = np.minimum.reduceat(np.where(failed, 1 << 40, number), group[:-1])
        mine = first == self.own[lead]
        alive = ~self.excluded[item] & ~failed[of_group] & mine[owner]
        most = self._most(of_group, occurs, size, alive, owner, len(lead))
        if self.ids is not None:
            bound = np.minimum(self.kind[row], len(self.kth) - 1)
            kth, highest = self.kth[bound, lead], most * (UNIT // 10)
            mine &= (highest > kth) | ((highest == kth) & (self.ids[row] <= self.kth_id[bound, lead]))
            alive &= mine[owner]
        raw = np.zeros(len(lead))
        used = np.flatnonzero(alive)
        single = self.n_required[lead] == 1
        heads = used[np.r_[True, owner[used][1:] != owner[used][:-1]]] if len(used) else used
        heads = heads[single[owner[heads]]]
        raw[owner[heads]] = occurs[heads] * WORD_WEIGHT
        used = used[~single[owner[used]]]
        if len(used):
            # a table of intervals has a row per item and a column per end
            items_of = np.bincount(owner[used], minlength=len(lead))
            ends_of = np.bincount(owner[used], weights=occurs[used], minlength=len(lead)).astype(np.int64)
            required = line >= 0
            required &= np.repeat(~self.excluded[item], size)
            for part in _parts(items_of * ends_of, CELLS):
                low, high = part[0], part[-1] + 1
                own = used[(owner[used] >= low) & (owner[used] < high)]
                if not len(own):
                    continue
                words = np.flatnonzero(required & (pair >= low) & (pair < high))
                spots = self._spots(pair[words] - low, entry[words])
                spans = (source, begin[own], occurs[own], width[own])
                raw[low:high] += self._density(owner[own] - low, self.groups[item[own]], spans, spots, high - low)
        kept = np.flatnonzero(mine)
        return lead[kept], row[kept], raw[kept]

    def _phrases(self, head: np.ndarray, size: np.ndarray, word: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Occurrences of phrases whose words all occur: number of the phrase, place of its first word."""
        if self.places_known is None:
            of_entry = np.repeat(np.arange(len(self.n_positions)), self.n_positions)
            self.places_known = of_entry * self.spread + self.positions
        n = self.n_positions[entry[head]]
        at = np.repeat(np.arange(len(head)), n)
        spot = self.positions[np.repeat(self.first_position[entry[head]], n) + places(_starts(n))]
        for j in range(1, int(size.max(initial=0))):
            more = size[at] > j
            next_ = head[at[more]] + j
            wanted = entry[next_] * self.spread + spot[more] + self.offset[word[next_]]
            place = np.minimum(np.searchsorted(self.places_known, wanted), len(self.places_known) - 1)
            keep = ~more
            keep[more] = self.places_known[place] == wanted
            at, spot = at[keep], spot[keep]
        return at, spot

    def _most(self, of_group: np.ndarray, occurs: np.ndarray, size: np.ndarray, alive: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        """No pair has more minimal intervals than this."""
        used = np.flatnonzero(alive)
        if not len(used):
            return np.zeros(n, np.int64)
        begin = np.flatnonzero(np.r_[True, of_group[used][1:] != of_group[used][:-1]])
        items = np.diff(np.r_[begin, len(used)])
        most = np.add.reduceat(occurs[used], begin) - items + 1
        words_only = np.maximum.reduceat(size[used], begin) == 1
        most = np.where(words_only, np.minimum(most, items * np.minimum.reduceat(occurs[used], begin)), most)
        return np.bincount(owner[used[begin]], weights=most, minlength=n).astype(np.int64)

    def _spots(self, pair: np.ndarray, entry: np.ndarray) -> np.ndarray:
        """Sorted places of all required words, as one number with the pair."""
        n = self.n_positions[entry]
        at = np.repeat(self.first_position[entry], n) + places(_starts(n))
        # numpy's own distinct values go through a hash table, which takes longer than this sort
        spots = np.sort(np.repeat(pair, n) * self.spread + self.positions[at])
        return spots[np.r_[True, spots[1:] != spots[:-1]][: len(spots)]]

    def _density(self, owner: np.ndarray, group: np.ndarray, spans: tuple, spots: np.ndarray, n: int) -> np.ndarray:
        """Cover density of `n` pairs from the occurrences of their items, which are ordered by pair and group."""
        source, begin, occurs, width = spans
        item = np.repeat(np.arange(len(owner)), occurs)
        start = source[np.repeat(begin, occurs) + places(_starts(occurs))]
        ends, end = np.unique(owner[item] * self.spread + start + width[item], return_inverse=True)
        of_end = ends // self.spread
        n_ends, n_items = np.bincount(of_end, minlength=n), np.bincount(owner, minlength=n)
        first_end, first_item = _starts(n_ends), _starts(n_items)
        table = _starts(n_ends * n_items)
        slot = np.arange(len(owner)) - first_item[owner]
        row = table[owner] + slot * n_ends[owner]
        # latest start of each item at each end, 0 before the first
        base = np.repeat(np.arange(len(owner)), n_ends[owner]) * self.spread
        latest = base.copy()
        latest[row[item] + end - first_end[owner[item]]] += start
        latest = np.maximum.accumulate(latest) - base
        pair = np.repeat(np.arange(n), n_ends * n_items)
        cell = places(table)
        column, slot = cell // n_items[pair], cell % n_items[pair]
        latest = latest[table[pair] + slot * n_ends[pair] + column]
        of_item = first_item[pair] + slot
        edge = np.flatnonzero((slot == 0) | (group[of_item] != group[np.maximum(of_item - 1, 0)]))
        reach = np.minimum.reduceat(latest, edge)
        reach = np.maximum.reduceat(reach, np.flatnonzero(slot[edge] == 0))
        before = np.r_[0, reach[:-1]]
        before[first_end[:-1][n_ends > 0]] = 0
        counted = np.flatnonzero(reach > before)
        key = of_end[counted] * self.spread
        stop, reach = ends[counted], key + reach[counted]
        noise = (stop - reach) - (np.searchsorted(spots, stop) - np.searchsorted(spots, reach))
        return np.bincount(of_end[counted], weights=WORD_WEIGHT / (1.0 + noise), minlength=n)
