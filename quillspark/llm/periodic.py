"""Maximal periodic runs of words: branching tandem repeats of a suffix tree, rotated and merged into runs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, chunks

#: Words that a run has at least.
LEAST = 12
WORD = "[^\\x20\\x09-\\x0D]+"
_STEP = np.uint64(0x9E3779B97F4A7C15)


class SuffixTree:
    """Suffix trees of several sequences in one set of arrays; suffixes of different sequences share no node.

    ``order`` lists the suffixes in order and ``rank`` is its inverse. An inner node is the stretch ``lo`` to ``hi`` of ``order`` whose
    suffixes share ``depth`` symbols and no more; ``parent`` is -1 at the top. Memory: some 60 bytes a symbol, and 4 more
    for each doubling of the longest repeat.
    """

    def __init__(self, symbols: np.ndarray, offsets: np.ndarray):
        n = len(symbols)
        length = np.diff(offsets)
        self.symbols = symbols
        self.start, self.end = np.repeat(offsets[:-1], length), np.repeat(offsets[1:], length)
        named = self._sorted(np.repeat(np.arange(len(length)), length))
        self.order = np.empty(n, np.int64)
        self.order[self.rank] = np.arange(n)
        self._nodes(self._shared(named))

    def _sorted(self, owner: np.ndarray) -> list[np.ndarray]:
        """Ranks of all suffixes by prefix doubling; the names of each doubling are returned. Only suffixes that tie are sorted anew."""
        n = len(owner)
        first = owner * (int(self.symbols.max(initial=0)) + 1) + self.symbols
        by = np.argsort(first, kind="stable")
        new = np.append(True, first[by][1:] != first[by][:-1])
        rank = np.empty(n, np.int64)
        rank[by] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        named, step = [], 1
        tied = by[~(new & np.append(new[1:], True))]
        while len(tied):
            named.append(rank.astype(np.int32))
            ahead = tied + step
            inside = ahead < self.end[tied]
            key = rank[tied] * (n + 1) + np.where(inside, rank[np.where(inside, ahead, 0)] + 1, 0)
            by = np.argsort(key, kind="stable")
            tied, key = tied[by], key[by]
            group = key // (n + 1)
            new, fresh = np.append(True, key[1:] != key[:-1]), np.append(True, group[1:] != group[:-1])
            at = np.arange(len(tied))
            rank[tied] = group + np.maximum.accumulate(np.where(new, at, 0)) - np.maximum.accumulate(np.where(fresh, at, 0))
            tied = tied[~(new & np.append(new[1:], True))]
            step *= 2
        self.rank = rank
        return named

    def _shared(self, named: list[np.ndarray]) -> np.ndarray:
        """Symbols that each suffix in order shares with the one before it, ended by a 0."""
        n = len(self.order)
        shared = np.zeros(n + 1, np.int64)
        if not named:
            return shared
        at = 1 + np.flatnonzero(named[0][self.order[1:]] == named[0][self.order[:-1]])
        a, b = self.order[at - 1], self.order[at]
        found = np.zeros(len(at), np.int64)
        for level in range(len(named) - 1, -1, -1):
            i, j = a + found, b + found
            inside = (i < self.end[a]) & (j < self.end[b])
            same = inside & (named[level][np.where(inside, i, 0)] == named[level][np.where(inside, j, 0)])
            found += same.astype(np.int64) << level
        shared[at] = found
        return shared

    def _nodes(self, shared: np.ndarray) -> None:
        inner = np.flatnonzero(shared)
        lo, hi = _smaller_before(shared, inner), _smaller_after(shared, inner)
        where = lo * len(shared) + hi
        _, first, node = np.unique(where, return_index=True, return_inverse=True)
        self.lo, self.hi, self.depth = lo[first], hi[first], shared[inner][first]
        of = np.full(len(shared), -1)
        of[inner] = node
        # Above a stretch lies the node of the deeper of the two gaps beside it.
        above = lambda left, right: of[np.where(shared[left] >= shared[right], left, right)]
        self.parent = above(self.lo, self.hi)
        leaf = np.arange(len(self.order))
        self.leaf_parent = above(leaf, leaf + 1)

    def heads(self) -> np.ndarray:
        """The top of each node's path of largest children."""
        by = np.lexsort((self.hi - self.lo, self.parent))
        largest = by[np.append(self.parent[by][1:] != self.parent[by][:-1], True)] if len(by) else by
        largest = largest[self.parent[largest] >= 0]
        head = np.arange(len(self.parent))
        head[largest] = self.parent[largest]
        while True:
            further = head[head]
            if np.array_equal(further, head):
                return head
            head = further

    def branching_repeats(self) -> tuple[np.ndarray, np.ndarray]:
        """(start, period) of the tandem repeats whose two halves are followed by different symbols.

        Each node looks at the leaves outside its largest child only, so a leaf is looked at on at most log n of the nodes
        above it: a leaf i of a node of depth d has a repeat with i + d or with i - d where that is a leaf of the node too.
        """
        head = self.heads()
        starts, periods = [], []
        leaf, node = np.arange(len(self.order)), self.leaf_parent
        while True:
            going = node >= 0
            leaf, node = leaf[going], node[going]
            if not len(leaf):
                break
            at, d = self.order[leaf], self.depth[node]
            for i, j in ((at, at + d), (at - d, at)):
                other = j if i is at else i
                inside = (other >= self.start[at]) & (other < self.end[at])
                r = self.rank[np.where(inside, other, 0)]
                inside &= (r >= self.lo[node]) & (r < self.hi[node])
                i, j, p, end = i[inside], j[inside], d[inside], self.end[at[inside]]
                last = j + p >= end
                branching = last | (self.symbols[np.where(last, 0, i + p)] != self.symbols[np.where(last, 0, j + p)])
                starts.append(i[branching])
                periods.append(p[branching])
            node = self.parent[head[node]]
        if not starts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        size = len(self.order) + 1
        both = np.unique(np.concatenate(starts) * size + np.concatenate(periods))
        return both // size, both % size


def _smaller_before(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The nearest place before each of ``at`` with a smaller value, by stretches of doubling length; place 0 holds 0."""
    least, tables = values, []
    while len(tables) < len(values).bit_length():
        tables.append(least)
        step = 1 << (len(tables) - 1)
        least = np.minimum(least[step:], least[:-step]) if len(least) > step else least[:0]
    place, own = at.copy(), values[at]
    for level in range(len(tables) - 1, -1, -1):
        low = place - (1 << level)  # the stretch low to place - 1
        inside = (low >= 0) & (low < len(tables[level]))
        free = inside.copy()
        free[inside] = tables[level][low[inside]] >= own[inside]
        place = np.where(free, low, place)
    return place - 1


def _smaller_after(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    return len(values) - 1 - _smaller_before(values[::-1], len(values) - 1 - at)


def _reach(symbols: np.ndarray, begin: np.ndarray, at: np.ndarray, period: np.ndarray) -> np.ndarray:
    """How far each repeat can be rotated to the left: symbols before ``at`` that equal those a period later."""
    far = np.zeros(len(at), np.int64)
    going, width = np.arange(len(at)), 8
    while len(going):
        some = []
        for part in np.array_split(going, max(1, len(going) * width // 2_000_000)):
            left = at[part, None] - far[part, None] - 1 - np.arange(width)
            inside = left >= begin[part, None]
            left = np.where(inside, left, 0)
            same = inside & (symbols[left] == symbols[left + np.where(inside, period[part, None], 0)])
            many = np.where(same.all(axis=1), width, same.argmin(axis=1))
            far[part] += many
            some.append(part[many == width])
        going, width = np.concatenate(some), min(width * 2, 4096)
    return far


def runs_of(symbols: np.ndarray, offsets: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, smallest period) of the runs of at least ``least`` symbols in each sequence, by start and period.

    A run's last repeat is a branching one, so all repeats that end together are rotations of the ends of runs. Of each end
    the smallest period is rotated to the left as far as it goes; its multiples within that run are the same run.
    """
    if not len(symbols):
        return symbols, symbols, symbols
    tree = SuffixTree(symbols, offsets)
    start, period = tree.branching_repeats()
    begin, end = tree.start[start] if len(start) else start, start + 2 * period
    by = np.lexsort((period, end))
    start, period, begin, end = start[by], period[by], begin[by], end[by]
    found = []
    while len(start):
        first = np.flatnonzero(np.append(True, end[1:] != end[:-1]))
        low = start[first] - _reach(symbols, begin[first], start[first], period[first])
        found.append((low, end[first], period[first]))
        group = np.cumsum(np.append(True, end[1:] != end[:-1])) - 1
        same = (period % period[first][group] == 0) & (start >= low[group])
        start, period, begin, end = start[~same], period[~same], begin[~same], end[~same]
    if not found:
        return start, end, period
    low, end, period = (np.concatenate(x) for x in zip(*found, strict=True))
    long = end - low >= least
    low, end, period = low[long], end[long], period[long]
    by = np.lexsort((period, low))
    return low[by], end[by], period[by]


def may_repeat(symbols: np.ndarray, offsets: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Whether a sequence holds some stretch of half of ``least`` symbols twice, as every run does. Equal hashes count as equal stretches,
    so no run is lost."""
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    half = (least + 1) // 2
    found = np.zeros(len(offsets) - 1, bool)
    if len(symbols) < half:
        return found
    count = len(symbols) - half + 1
    hashed = owner[:count].astype(np.uint64)
    for k in range(half):
        hashed = (hashed + symbols[k : k + count].astype(np.uint64)) * _STEP
        hashed ^= hashed >> np.uint64(29)
    inside = owner[:count] == owner[half - 1 :]
    hashed, owner = hashed[inside], owner[:count][inside]
    by = np.argsort(hashed)
    hashed, owner = hashed[by], owner[by]
    twice = hashed[1:] == hashed[:-1]
    found[owner[1:][twice]] = True
    return found


def _scan(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            words = Words(b.column("text"), fold=False)
            n, offsets = np.diff(words.offsets), words.offsets
            some = np.flatnonzero(may_repeat(words.codes, offsets, least))
            base = np.concatenate([[0], np.cumsum(n[some])]).astype(np.int64)
            place = np.repeat(offsets[some] - base[:-1], n[some]) + np.arange(base[-1])
            low, end, period = runs_of(words.codes[place], base, least)
            doc = np.searchsorted(base, low, side="right") - 1
            # A run's words after its first period go.
            change = np.zeros(len(words.codes) + 1, np.int64)
            shift = (offsets[some] - base[:-1])[doc] if len(doc) else doc
            np.add.at(change, low + period + shift, 1)
            np.add.at(change, end + shift, -1)
            kept = np.cumsum(change[:-1]) == 0
            owner = np.repeat(np.arange(len(n)), n)
            ends = np.concatenate([[0], np.cumsum(np.bincount(owner[kept], minlength=len(n)))]).astype(np.int32)
            flat = words.words.cast(pa.large_string()).take(pa.array(words.codes[kept]))
            collapsed = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), flat), pa.scalar(" ", pa.large_string()))
            parts = pa.StructArray.from_arrays([pa.array(low - base[doc]), pa.array(end - low), pa.array(period)], ["start", "length", "period"])
            many = np.bincount(some[doc], minlength=len(n)) if len(doc) else np.zeros(len(n), np.int64)
            runs = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(many)]).astype(np.int32)), parts)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n.astype(np.int64)), runs, collapsed.cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    return run


def periodic_runs(documents: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of each row: the maximal periodic runs of its words, and its text without their repeats.

    Words are runs of characters other than space and 0x09-0x0D, taken as they are. A run (start, length, period; words from 0, by
    start and then period) is a stretch of at least ``least`` words and two of its smallest periods, that no word beside it
    extends. ``collapsed`` holds the words that lie after no run's first period, joined by a space.

    Every document is looked at by itself, whole, in the task that reads it; nothing is shuffled. Null and empty texts, and
    texts without words, have no runs and an empty ``collapsed``. Repeated rows and null ids give a row each. A very long text takes
    memory in proportion to its words (see ``SuffixTree``); a text without a repeated half of ``least`` words builds no tree. An empty table gives
    an empty result. Other columns are ignored.
    """
    rows = documents.selectExpr("CAST(doc_id AS long) AS doc_id", "text")
    return rows.mapInArrow(_scan(least), "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def with_planted_runs(documents: DataFrame) -> DataFrame:
    """(doc_id, text): one document in ten, by crc32 of its id, repeats a stretch of its words from some word on to its end.

    Documents with a null id or without words stay as they are."""
    hashed = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", hashed.alias("__h"))
    words = F.when(F.col("__h") % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    g, n = F.floor(F.col("__h") / 10), F.size("__w")

    def planted(w: Column) -> Column:
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        repeated = F.transform(F.sequence(F.lit(0).cast("long"), n - a - 1), lambda i: F.get(w, (a + i % p).cast("int")))
        return F.array_join(F.concat(F.slice(w, F.lit(1), a.cast("int")), repeated), " ")

    rows = rows.withColumn("__w", words)
    return rows.select("doc_id", F.when(n > 0, planted(F.col("__w"))).otherwise(F.col("text")).alias("text"))


def digest(found: DataFrame) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256) of the rows of ``periodic_runs``:
    the longest run (of equal ones the first, then the one with the smallest period), and hashes of all runs and of the collapsed text."""
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    said = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("x"), F.sha2(said, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    length, period = F.col("x.length"), -F.col("x.period")
    return rows.select("doc_id", "n_runs", (-F.col("x.start")).alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
