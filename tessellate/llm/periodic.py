"""Periodic runs: words that repeat over and over, found in suffix trees.

The method is Stoye and Gusfield's.  A suffix tree's node whose path is D words long and
that has suffixes i and i + D below different children marks a branching tandem repeat:
D words, the same D words again, and another word after them.  Of each node only the
suffixes outside its largest child are looked at, so a text of n words costs O(n log n)
looks.  Every maximal run ends in one branching tandem repeat; rotating that to the left,
as long as the words before agree, and merging what has the same place gives the run.

Trees of the documents of a batch are built together, as arrays: ranks of substrings of
1, 2, 4, ... words, the order of suffixes, and the intervals of common prefixes (the inner
nodes).  Documents never share a node.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pick

#: A batch's words (a longer document is a batch of its own).
BATCH_WORDS = 1 << 18
#: Least length of a run, and how often its period fits at least.
LEAST_WORDS, LEAST_TIMES = 6, 4


class _Numbers(dict):
    """Words numbered as they come."""

    def __missing__(self, word):
        self[word] = n = len(self)
        return n


def _spread(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges, and the range that each comes from."""
    of = np.repeat(np.arange(len(sizes)), sizes)
    before = np.cumsum(sizes) - sizes
    return np.arange(len(of)) - before[of] + starts[of], of


class Suffixes:
    """Order of the suffixes of a sequence in which no suffix is the beginning of another, and their common prefixes.

    ``levels[k]`` has the same number for equal stretches of 2^k symbols.
    """

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        order = np.argsort(symbols, kind="stable")
        head = np.r_[True, symbols[order][1:] != symbols[order][:-1]] if n else np.zeros(0, bool)
        rank = np.empty(n, np.int64)
        rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
        made = np.where(head, 0, -1)  # the level at which a suffix parted from the one before it
        self.levels, size = [rank.astype(np.int32)], 1
        open_ = order[~(head & np.r_[head[1:], True])] if n else order
        while len(open_):
            old = rank[open_]
            keys = old * (n + 1) + rank[np.minimum(open_ + size, n - 1)]
            by = np.argsort(keys, kind="stable")
            open_, keys, old = open_[by], keys[by], old[by]
            group = np.r_[True, old[1:] != old[:-1]]
            apart = np.r_[True, keys[1:] != keys[:-1]]
            at = np.arange(len(open_))
            place = old + at - np.maximum.accumulate(np.where(group, at, 0))
            fresh = place[np.maximum.accumulate(np.where(apart, at, 0))]
            rank[open_] = fresh
            made[place[apart & ~group]] = len(self.levels)
            self.levels.append(rank.astype(np.int32))
            size *= 2
            open_ = open_[~(apart & np.r_[apart[1:], True])]
        self.rank = rank
        self.order = np.empty(n, np.int64)
        self.order[rank] = np.arange(n)
        self.common = np.zeros(n, np.int64)  # symbols that a suffix shares with the one before it
        for level in range(1, len(self.levels)):
            parted = np.flatnonzero(made == level)
            a, b = self.order[parted - 1], self.order[parted]
            length = np.full(len(parted), 1 << (level - 1))
            for k in range(level - 2, -1, -1):
                length += (1 << k) * (self.levels[k][a + length] == self.levels[k][b + length])
            self.common[parted] = length

    def inner(self) -> tuple[np.ndarray, ...]:
        """``depth, first, last`` of the inner nodes, and ``first, size`` of the children but each node's largest, with their node."""
        at = np.flatnonzero(self.common > 0)
        if not len(at):
            return (at,) * 6
        low = np.r_[self.common, 0]
        before, after = np.arange(-1, len(low) - 1), np.arange(1, len(low) + 1)
        before[0], after[-1] = 0, len(low) - 1
        for near, keep in ((before, 0), (after, len(low) - 1)):  # nearest smaller entry, by jumps over entries known to be no smaller
            todo = at
            while len(todo):
                todo = todo[(low[near[todo]] >= low[todo]) & (near[todo] != keep)]
                near[todo] = near[near[todo]]
        first, last = before[at], after[at] - 1
        by = np.lexsort((at, last, first))
        at, first, last = at[by], first[by], last[by]
        head = np.r_[True, (first[1:] != first[:-1]) | (last[1:] != last[:-1])]
        node = np.cumsum(head) - 1
        heads = np.flatnonzero(head)
        depth, first, last = self.common[at[heads]], first[heads], last[heads]
        starts = np.concatenate([first, at])
        owner = np.concatenate([np.arange(len(heads)), node])
        by = np.lexsort((starts, owner))
        starts, owner = starts[by], owner[by]
        ends = np.where(np.r_[owner[1:] != owner[:-1], True], last[owner] + 1, np.r_[starts[1:], 0])
        sizes = ends - starts
        by = np.lexsort((sizes, owner))
        largest = by[np.r_[owner[by][1:] != owner[by][:-1], True]]
        rest = np.ones(len(starts), bool)
        rest[largest] = False
        return depth, first, last, starts[rest], sizes[rest], owner[rest]

    def shared_before(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many symbols before places ``a`` and ``b`` (a < b) agree."""
        length = np.zeros(len(a), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            step, level, todo = 1 << k, self.levels[k], np.arange(len(a))
            while len(todo):
                x = a[todo] - length[todo] - step
                todo, x = todo[x >= 0], x[x >= 0]
                todo = todo[level[x] == level[b[todo] - length[todo] - step]]
                length[todo] += step
        return length


def branching(suffixes: Suffixes, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and half lengths of all branching tandem repeats; they may repeat."""
    depth, first, last, starts, sizes, owner = suffixes.inner()
    n, found, step = len(symbols), [], 1 << 20
    bounds = np.searchsorted(np.cumsum(sizes), np.arange(step, int(sizes.sum()) + step, step)) + 1 if len(sizes) else []
    lo = 0
    for hi in bounds:
        ranks, of = _spread(starts[lo:hi], sizes[lo:hi])
        of = owner[lo:hi][of]
        leaf, d, l, r = suffixes.order[ranks], depth[of], first[of], last[of]  # noqa: E741
        for other in (leaf + d, leaf - d):
            ok = (other >= 0) & (other < n)
            a, b, e = np.minimum(leaf, other)[ok], np.maximum(leaf, other)[ok], d[ok]
            at = suffixes.rank[other[ok]]
            hit = (at >= l[ok]) & (at <= r[ok])
            a, b, e = a[hit], b[hit], e[hit]
            hit = symbols[b] != symbols[b + e]
            found.append((a[hit], e[hit]))
        lo = hi
    if not found:
        return (np.zeros(0, np.int64),) * 2
    return np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])


def maximal_runs(symbols: np.ndarray, least: int = LEAST_WORDS, times: int = LEAST_TIMES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``start, length, period`` of all runs by start and period; each stretch between separators is a text of its own.

    A run has ``least`` symbols or more, ``times`` (2 or more) whole periods at least, can't
    be extended on either side, and its period is its smallest.  No symbol may occur on both
    sides of a separator, which occurs once; the last symbol is one.
    """
    suffixes = Suffixes(symbols)
    start, period = branching(suffixes, symbols)
    need = np.maximum(least - 2 * period, (times - 2) * period)
    for back in range(1, 5):  # most repeats end here
        ok = (need < back) | ((start >= back) & (symbols[np.maximum(start - back, 0)] == symbols[np.maximum(start - back, 0) + period]))
        start, period, need = start[ok], period[ok], need[ok]
    back = suffixes.shared_before(start, start + period)
    ok = back >= need
    start, period, length = start[ok] - back[ok], period[ok], (2 * period + back)[ok]
    by = np.lexsort((period, length, start))  # a stretch's smallest period comes first, its multiples go
    start, length, period = start[by], length[by], period[by]
    keep = np.r_[True, (start[1:] != start[:-1]) | (length[1:] != length[:-1])] if len(start) else np.zeros(0, bool)
    start, length, period = start[keep], length[keep], period[keep]
    by = np.lexsort((period, start))
    return start[by], length[by], period[by]


def runs_in(texts: list[list[bytes]], least: int = LEAST_WORDS, times: int = LEAST_TIMES) -> list[np.ndarray]:
    """For each text, given as its words, an array of rows (start, length, period) by start and period."""
    sizes = np.array([len(t) for t in texts], np.int64)
    numbers = _Numbers()
    words = [np.fromiter(map(numbers.__getitem__, t), np.int64, len(t)) for t in texts]
    ends = np.cumsum(sizes + 1)
    symbols = np.empty(int(ends[-1]) if len(ends) else 0, np.int64)
    for k, (w, end) in enumerate(zip(words, ends.tolist(), strict=True)):
        symbols[end - 1 - len(w) : end - 1] = w + k * (len(numbers) + 1)
        symbols[end - 1] = k * (len(numbers) + 1) + len(numbers)
    start, length, period = maximal_runs(symbols, least, times)
    cuts = np.searchsorted(start, np.r_[0, ends])
    return [np.stack([start[a:b] - (end - 1 - size), length[a:b], period[a:b]], 1) for a, b, end, size in zip(cuts[:-1].tolist(), cuts[1:].tolist(), ends.tolist(), sizes.tolist(), strict=True)]


def collapsed(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of ``n`` words stay when every run is cut to its first period."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edges, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edges)[:n] == 0


def _batches(texts: list[str | None]) -> Iterator[list[list[bytes]]]:
    held, size = [], 0
    for t in texts:
        words = (t or "").encode("utf-8", "surrogatepass").split()  # of bytes: ASCII white space only
        if held and size + len(words) > BATCH_WORDS:
            yield held
            held, size = [], 0
        held.append(words)
        size += len(words)
    if held:
        yield held


def with_runs(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", least: int = LEAST_WORDS, times: int = LEAST_TIMES) -> DataFrame:
    """``doc_id, runs, collapsed``: runs as an array of (start, length, period) by start and period, and the text without their repetitions.

    Words are runs of anything but ASCII white space; the collapsed text has single blanks
    between them.  Null, empty and blank texts have no run and an empty collapsed text.
    Rows are worked on apart: repeated rows and null ids stay as they are, an empty table
    gives an empty table, and the only skew is one text's length (memory grows with it and
    with the logarithm of its longest repeat).
    """
    rows = pick(docs, k=id_col, t=text_col)
    kind = rows.schema["k"].dataType.simpleString()
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in _batches(batch.column("t").to_pylist()):
                found = runs_in(texts, least, times)
                short = []
                for words, r in zip(texts, found, strict=True):
                    if len(r):
                        words = [words[k] for k in np.flatnonzero(collapsed(len(words), r)).tolist()]
                    short.append(b" ".join(words))
                ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
                flat = np.concatenate([*found, np.zeros((0, 3), np.int64)])
                structs = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, c])) for c in range(3)], fields=list(run_type.value_type))
                runs = pa.ListArray.from_arrays(pa.array(ends), structs)
                yield pa.RecordBatch.from_arrays([batch.column("k").slice(at, len(texts)), runs, pa.array(short, pa.binary()).cast(pa.string())], ["k", "runs", "collapsed"])
                at += len(texts)

    return rows.mapInArrow(run, f"k {kind}, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string").withColumnRenamed("k", id_col)


def densest(runs: Column) -> Column:
    """Of an array of runs that with the greatest length/period (ties: smallest start, then period); null of none."""
    better = lambda a, b: (a["length"] * b["period"] > b["length"] * a["period"])
    return F.aggregate(runs, F.get(runs, F.lit(0)), lambda best, x: F.when(better(x, best), x).otherwise(best))


def digests(docs: DataFrame) -> DataFrame:
    """One row per document: number of runs, the densest one, and digests of all runs and of the collapsed text."""
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    lines = F.concat(F.array_join(line, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    found = with_runs(docs).withColumn("best", densest(F.col("runs")))
    best = F.col("best")
    return found.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        best["start"].alias("start"),
        best["length"].alias("length"),
        best["period"].alias("period"),
        F.floor(best["length"] * 1000 / best["period"]).cast("bigint").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def planted(docs: DataFrame) -> DataFrame:
    """``doc_id, text``: about one document in ten gets a periodic end, by the checksum of its id; null ids never do."""
    rows = pick(docs, doc_id="doc_id", text="text")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    g, n = F.floor(h / 10).cast("bigint"), F.size("_words").cast("bigint")
    chosen = rows.withColumn("_chosen", F.coalesce(h % 10 == 0, F.lit(False))).withColumn("_words", F.when(F.col("_chosen"), words))
    a = F.pmod(g, n)
    shaped = chosen.withColumn("_a", F.when(F.col("_chosen") & (n > 0), a)).withColumn("_p", 1 + F.floor((n - F.col("_a")) / (3 + F.pmod(g, F.lit(8)))).cast("bigint"))
    place = lambda w, i: F.when(i < F.col("_a"), w).otherwise(F.get(F.col("_words"), (F.col("_a") + F.pmod(i - F.col("_a"), F.col("_p"))).cast("int")))
    text = F.when(F.col("_a").isNotNull(), F.array_join(F.transform("_words", place), " ")).otherwise(F.col("text"))
    return shaped.select("doc_id", text.alias("text"))
