"""Best-fit packing of token sequences by linear grouping.

Lengths are at most the capacity, so their histogram has at most ``capacity`` entries
whatever the corpus; it alone goes to the driver, which plans the bins there:

1. lengths over ``capacity // small_parts`` are *large*: sorted, cut into groups of equal
   cardinality, each group rounded up to its largest length (groups of one size merge);
2. the few rounded sizes give a cutting-stock program, solved by column generation; the
   integral part of each configuration's multiplicity is used;
3. actual lengths take their group's places in the configurations, so that bins fall
   into runs of equal fill;
4. what is left, small lengths included, goes by best fit in decreasing order into the
   gaps of those runs, new bins being opened only where nothing fits.

The plan is a table of runs (length, ranks, first bin, pieces a bin, offset).  The
executors number the pieces of each length and look their places up in it.
"""

from __future__ import annotations

import json
import os
import re
import sys
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import pick, written

#: Segments whose ids a worker remembers; beyond it the memory starts anew.
CACHE_SEGMENTS = 150_000
#: A space between two other white-space-free neighbours always starts a token.
CUT = re.compile(r"(?<=\S)(?= \S)")
ODD = re.compile(r" \s|\s |^ | $")
#: Runs of white space that the regular expressions of ``tiktoken`` may give up on; their segments go to ``tokenizers``.
LONG_BLANK = re.compile(r"\s{2000}")
PIECE_SCHEMA = "piece int, start bigint, length bigint, ids_crc32 bigint"


#: How byte-level tokenizers cut a text into words (a fixed value).
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def merge_ranks(path: str) -> tuple[dict[bytes, int], list[str]]:
    """Token bytes with their merge rank, which is their id, and the added tokens of a byte-level BPE file."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    bpe, cut = spec["model"], spec["pre_tokenizer"] or {}
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]  # these stand for themselves
    byte_of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
    pairs = [m.split(" ") if isinstance(m, str) else m for m in bpe["merges"]]
    made = [bpe["vocab"][a + b] for a, b in pairs]
    plain = bpe["type"] == "BPE" and cut.get("type") == "ByteLevel" and cut.get("use_regex") and not cut.get("add_prefix_space") and not spec["normalizer"]
    if not plain or made != sorted(made) or len(made) + 256 != len(bpe["vocab"]):
        raise ValueError("not a plain byte-level BPE whose ids ascend with its merges")
    return {bytes(byte_of[c] for c in t): i for t, i in bpe["vocab"].items()}, [t["content"] for t in spec["added_tokens"]]


class ByteTokenizer:
    """Packed 32-bit ids of texts by a ``tokenizers`` file, remembering recent segments.

    New segments are merged by ``tiktoken`` with the file's own ranks, which gives the same
    ids several times faster; segments with an added token or a very long run of white space
    go to ``tokenizers`` itself.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        ranks, added = merge_ranks(path)
        self.tokenizer, self.spaced = Tokenizer.from_file(path), _Spaced(self.packed)
        self.ordinary = tiktoken.Encoding("file", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.added = re.compile("|".join(map(re.escape, added))) if added else None

    def packed(self, segment: str) -> bytes:
        if (self.added and self.added.search(segment)) or (len(segment) >= 2000 and LONG_BLANK.search(segment)):
            return np.array(self.tokenizer.encode(segment, add_special_tokens=False).ids, "<u4").tobytes()
        ids = array("I", self.ordinary(segment))
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def encode(self, text: str) -> bytes:
        """A text is cut at spaces that always start a token; what is between is looked up."""
        if not text:
            return b""
        if len(self.spaced) > CACHE_SEGMENTS:
            self.spaced.clear()
        first, *rest = [s[k > 0 :] for k, s in enumerate(CUT.split(text))] if ODD.search(text) else text.split(" ")
        return self.packed(first) + b"".join(map(self.spaced.__getitem__, rest))


class _Spaced(dict):
    """Packed ids of a space and the key, made when first asked for."""

    def __init__(self, packed):
        super().__init__()
        self.packed = packed

    def __missing__(self, segment: str) -> bytes:
        self[segment] = ids = self.packed(" " + segment)
        return ids


@lru_cache(2)
def tokenizer_of(path: str) -> ByteTokenizer:
    """One for each file and worker, which outlives a task."""
    return ByteTokenizer(path)


def cuts(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; all but the first have ``capacity`` tokens."""
    first = (length - 1) % capacity + 1
    return [(0, first), *((s, capacity) for s in range(first, length, capacity))]


def pieces(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, piece, start, length, ids_crc32`` of every whole text, ``end_id`` appended.

    A null text counts as empty (one piece of one token).  Null and repeated ids are kept
    as they are; further columns are left out.
    """
    kind = docs.schema.fields[docs.columns.index(id_col)].dataType.simpleString()
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = tokenizer_of(path)
        for batch in batches:
            rows, out = [], []
            for k, text in enumerate(batch.column("t")):
                ids = tokenizer.encode(text.as_py() or "") + end
                for p, (s, n) in enumerate(cuts(len(ids) // 4, capacity)):
                    rows.append(k)
                    out.append((p, s, n, zlib.crc32(ids[4 * s : 4 * (s + n)])))
            columns = [pa.array(x, t) for x, t in zip(zip(*out, strict=True) if out else [[]] * 4, (pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("k").take(pa.array(rows, pa.int64())), *columns], [id_col, "piece", "start", "length", "ids_crc32"])

    return pick(docs, k=id_col, t=text_col).mapInArrow(run, f"{id_col} {kind}, {PIECE_SCHEMA}")


# -- the plan, on the driver ---------------------------------------------------------


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 3000) -> list[tuple[np.ndarray, float]]:
    """Counts of each size in a bin, and how many such bins: the least by linear programming.

    Column generation: a basis of one configuration a size, exchanged as long as a knapsack
    over the sizes' prices finds a configuration worth more than a bin.
    """
    n = len(sizes)
    basis = np.diag((capacity // sizes).astype(float))
    times = demand / np.diag(basis)
    most = int(capacity // sizes.min())
    room = np.arange(capacity + 1)[:, None] - sizes[None, :]
    fits = room >= 0
    room = np.maximum(room, 0)
    for round_ in range(rounds + 1):
        if round_ == rounds:
            raise RuntimeError(f"no configurations within 0.05 % of the least after {rounds} rounds")
        prices = np.linalg.solve(basis.T, np.ones(n))
        best, choices = np.zeros(capacity + 1), []
        for _ in range(most):
            offers = np.where(fits, best[room] + prices, -np.inf)
            pick_ = offers.argmax(1)
            value = offers[np.arange(capacity + 1), pick_]
            choices.append(np.where(value > best + 1e-12, pick_, -1))
            best = np.maximum(best, value)
        if best[capacity] <= 1.0005:  # Farley's bound: within 0.05 % of the least
            break
        column, at = np.zeros(n), capacity
        for choice in reversed(choices):
            if (i := choice[at]) >= 0:
                column[i] += 1
                at -= int(sizes[i])
        step = np.linalg.solve(basis, column)
        usable = step > 1e-9
        ratio = np.where(usable, times / np.where(usable, step, 1), np.inf)
        out = int(ratio.argmin())
        by = ratio[out]
        times = np.maximum(times - by * step, 0)
        times[out], basis[:, out] = by, column
    return [(basis[:, k], float(times[k])) for k in range(n)]


def plan(histogram: dict[int, int], capacity: int, groups: int = 160, small_parts: int = 4) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Runs (length, first rank, count, first bin, pieces a bin, offset), and the number of bins.

    ``histogram`` counts the pieces of each length (1 to ``capacity``); every rank of every
    length is in exactly one run.
    """
    runs, bins = [], 0
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # (first bin, bins) by room left
    rest = {n: [(0, c)] for n, c in histogram.items() if c}  # (first rank, count) not placed yet
    large = sorted((n for n in rest if capacity // small_parts < n < capacity), reverse=True)
    total = sum(histogram[n] for n in large)
    if total:
        quota, members, seen = -(-total // groups), defaultdict(list), 0
        tops: dict[int, int] = {}
        for n in large:
            first, left = 0, histogram[n]
            while left:
                top = tops.setdefault(seen // quota, n)
                take = min(left, quota - seen % quota)
                members[top].append((n, first, take))
                first, left, seen = first + take, left - take, seen + take
            rest[n] = []
        sizes = np.array(sorted(members, reverse=True))
        demand = np.array([sum(c for _, _, c in members[s]) for s in sizes.tolist()], float)
        for column, times in configurations(sizes, demand, capacity):
            times = int(times + 1e-9)
            fills = [(0, times, 0)] if times else []  # (first bin of the configuration, bins, tokens there)
            for s, copies in zip(sizes.tolist(), column.astype(int).tolist(), strict=True):
                for _ in range(copies):
                    after = []
                    for b, c, fill in fills:
                        while c and members[s]:
                            n, first, count = members[s].pop()
                            take = min(c, count)
                            runs.append((n, first, take, bins + b, 1, fill))
                            after.append((b, take, fill + n))
                            if count > take:
                                members[s].append((n, first + take, count - take))
                            b, c = b + take, c - take
                        if c:
                            after.append((b, c, fill))
                    fills = after
            for b, c, fill in fills:
                gaps[capacity - fill].append((bins + b, c))
            bins += times
        for left in members.values():
            for n, first, count in left:
                rest[n].append((first, count))
    for n in sorted(rest, reverse=True):
        for first, count in rest[n]:
            while count:
                room = next((r for r in range(n, capacity + 1) if gaps.get(r)), None)
                if room is None:
                    room, opened = capacity, -(-count // (capacity // n))
                    gaps[room].append((bins, opened))
                    bins += opened
                b, c = gaps[room].pop()
                each = room // n
                whole = min(c, count // each)
                if whole:
                    runs.append((n, first, whole * each, b, each, capacity - room))
                    gaps[room - each * n].append((b, whole))
                    first, count, b, c = first + whole * each, count - whole * each, b + whole, c - whole
                if c and 0 < count < each:
                    runs.append((n, first, count, b, count, capacity - room))
                    gaps[room - count * n].append((b, 1))
                    b, c, count = b + 1, c - 1, 0
                if c:
                    gaps[room].append((b, c))
    return runs, bins


# -- the places, on the executors ----------------------------------------------------


def places(parts: DataFrame, capacity: int = 1024, rows_a_bucket: int = 2000) -> DataFrame:
    """``parts`` (as from :func:`pieces`, on disk) with ``sequence_id`` and ``offset``.

    Ranks within a length are made without gathering a length: rows fall by hash into
    buckets, each (length, bucket) is numbered apart, and a running sum of the bucket
    counts lifts the numbers, so a length that a third of all rows have is spread too.
    """
    spark, (id_col, *_) = parts.sparkSession, parts.columns
    counted = parts.groupBy("length").count().collect()  # at most `capacity` rows
    histogram = {int(r[0]): int(r[1]) for r in counted}
    runs, _ = plan(histogram, capacity)
    table = spark.createDataFrame(
        [(n, first, first + count, b, each, offset) for n, first, count, b, each, offset in runs],
        "_n bigint, _from bigint, _to bigint, _bin bigint, _each bigint, _at bigint",
    )
    buckets = max(1, sum(histogram.values()) // rows_a_bucket)
    order = [F.col(c) for c in parts.columns]
    spread = parts.withColumn("_bucket", F.pmod(F.xxhash64(id_col, "piece"), F.lit(buckets)))
    sums = spread.groupBy("length", "_bucket").agg(F.count("*").alias("_count"))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("length", "_bucket", F.coalesce(F.sum("_count").over(before), F.lit(0)).alias("_before"))
    numbered = spread.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_bucket").orderBy(*order)))
    ranked = numbered.join(sums, ["length", "_bucket"]).withColumn("_rank", F.col("_rank") - 1 + F.col("_before"))
    # The plan's size depends on the capacity and the groups, not on the corpus.
    on = (F.col("length") == F.col("_n")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to"))
    k = F.col("_rank") - F.col("_from")
    return ranked.join(F.broadcast(table), on).select(
        *parts.columns,
        (F.col("_bin") + F.floor(k / F.col("_each"))).cast("bigint").alias("sequence_id"),
        (F.col("_at") + F.pmod(k, F.col("_each")) * F.col("length")).cast("bigint").alias("offset"),
    )


def pack(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` tokens; one row per piece.

    ``id_col, piece, start, length, ids_crc32, sequence_id, offset``.  Equal pieces may
    trade places; the number of sequences depends on the lengths alone.  An empty table
    gives an empty table.
    """
    return places(written(pieces(docs, path, capacity, end_id, id_col, text_col), "pieces"), capacity)
