"""Set-similarity join of documents on word shingles, by vertical partitioning.

All shingles stand in one global order, rare ones first, which is cut into fragments of
about equal weight.  A document's set falls into one segment for each fragment.  For a pair
of documents the overlap of each pair of segments is counted apart, fragment after
fragment, and summed; a pair whose segments already differ too much is dropped.

Only pairs that can be similar are counted: two sets of the wanted similarity share one of
their first shingles in the global order, and their sizes, places and parities must allow
it.  Documents of one set are one class, and classes that are already joined through
others aren't compared.  A random class that all others of its shingle were compared with
leaves that shingle, so what is left shrinks from round to round.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pick, written
from .components import components
from .hashed import MIX

WORDS, LEAST = 5, 80
FRAGMENTS = 4
#: Documents of a slice that is worked on at once, and shingles that are counted before they are dealt out.
SLICE, COUNTED = 256, 1 << 20
#: Shingles whose frequency orders them, at most: the most frequent ones.  All others come before them, by hash.
FREQUENT, SELDOM = 1 << 19, 3
#: 64-bit words of parities that a class carries.
PARITIES = 8
#: Rounds in which classes of different groups are compared with one of their key each, before all that is left are compared.
STARS = 5
#: All that is left is compared at once as soon as it has no more meetings than so many for each row that met at first.
MEETINGS = 1
#: Ends of pairs that every task gets whole, at most; more of them are joined with the texts by a shuffle.
FEW = 10_000


#: A random number for every byte, the same for both cases of A-Z, and whether it is white space.
_BYTES = np.random.default_rng(42).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_BYTES[65:91] = _BYTES[97:123]
_BLANK = np.isin(np.arange(256), list(b" \t\n\x0b\f\r"))


def _mixed(hashes: np.ndarray) -> np.ndarray:
    hashes = (hashes ^ (hashes >> np.uint64(29))) * MIX[0]
    return hashes ^ (hashes >> np.uint64(32))


class Shingles:
    """The set of a text's word shingles, as ascending 64-bit hashes.

    A word's hash is a polynomial of its bytes' random numbers, a shingle's one of its
    words' hashes, so both are made without a loop over words.
    """

    def __init__(self, words: int = WORDS):
        self.words = words
        self.powers = np.ones(1, np.uint64)

    def word_hashes(self, text: str | None) -> np.ndarray:
        raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
        solid = np.flatnonzero(~_BLANK[raw])
        if not len(solid):
            return np.zeros(0, np.uint64)
        first = np.flatnonzero(np.r_[True, np.diff(solid) > 1])
        sizes = np.diff(np.r_[first, len(solid)])
        within = np.arange(len(solid)) - np.repeat(first, sizes)
        with np.errstate(over="ignore"):
            if sizes.max() > len(self.powers):
                self.powers = np.cumprod(np.r_[np.uint64(1), np.full(2 * sizes.max(), MIX[2])])
            return _mixed(np.add.reduceat(_BYTES[raw[solid]] * self.powers[within], first) + sizes.astype(np.uint64))

    def of(self, text: str | None) -> np.ndarray:
        hashes = self.word_hashes(text)
        size = min(self.words, len(hashes))
        if not size:
            return hashes
        with np.errstate(over="ignore"):
            out = hashes[: len(hashes) - size + 1] + np.uint64(size)
            for k in range(1, size):
                out = out * MIX[1] + hashes[k : len(hashes) - size + 1 + k]
            out = _mixed(out)
        out.sort()
        return out if (apart := out[1:] != out[:-1]).all() else out[np.r_[True, apart]]


def first_of(n: int, least: int) -> int:
    """How many of the first members of a set of ``n`` must be looked at, so that none of ``least`` per cent is missed."""
    return n - -(-least * n // 100) + 1 if n else 0


# -- the global order ------------------------------------------------------------------


def frequencies(texts: DataFrame, words: int, sets: Callable[[int], Callable[[str | None], np.ndarray]] = lambda words: Shingles(words).of) -> DataFrame:
    """``key, n``: the upper 48 bits of shingles that ``SELDOM`` or more documents have, and how many have them; under key -1 all of them.

    Tasks count what they read and deal the keys out by range, so a shingle that many
    documents share is a few numbers only when it is shuffled.
    """
    parts = 4 * int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def counted(held: list[np.ndarray]) -> pa.RecordBatch:
        keys, n = np.unique(np.concatenate(held) >> np.uint64(16), return_counts=True)
        cuts = np.searchsorted(keys, (np.arange(parts + 1, dtype=np.uint64) * np.uint64((1 << 48) // parts)))
        cuts[-1] = len(keys)
        packed = np.ascontiguousarray(keys.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:])
        rows = [(p, packed[a:b].tobytes(), n[a:b].astype(np.uint32).tobytes()) for p, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)) if b > a]
        part, k, c = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(k, pa.binary()), pa.array(c, pa.binary())], ["part", "keys", "counts"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, held, size = sets(words), [], 0
        for batch in batches:
            for t in batch.column("t"):
                own = made(t.as_py())
                if len(own):
                    held.append(own)
                    size += len(own)
                if size >= COUNTED:
                    yield counted(held)
                    held, size = [], 0
        if held:
            yield counted(held)

    def summed(rows: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
        raw = np.frombuffer(b"".join(k for k, _ in rows), np.uint8).reshape(-1, 6)
        keys = np.zeros((len(raw), 8), np.uint8)
        keys[:, 2:] = raw
        keys = keys.view(">u8").reshape(-1).astype(np.int64)
        n = np.frombuffer(b"".join(c for _, c in rows), np.uint32).astype(np.int64)
        by = np.argsort(keys)
        keys, n = keys[by], n[by]
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        total = np.add.reduceat(n, starts)
        often = total >= SELDOM
        return pa.RecordBatch.from_arrays([pa.array(np.r_[keys[starts][often], -1]), pa.array(np.r_[total[often], total.sum()])], ["key", "n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, part = [], None
        for batch in batches:
            for p, k, c in zip(batch.column("part").to_pylist(), batch.column("keys"), batch.column("counts"), strict=True):
                if p != part and held:
                    yield summed(held)
                    held = []
                part = p
                held.append((k.as_py(), c.as_py()))
        if held:
            yield summed(held)

    dealt = texts.select("t").mapInArrow(count, "part int, keys binary, counts binary")
    return dealt.repartition(parts // 4, "part").sortWithinPartitions("part").mapInArrow(add, "key bigint, n bigint")


def most_frequent(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of :func:`frequencies` and how many documents have them: all of the highest powers of frequency that ``most`` rows hold."""
    listed = counts.filter("key >= 0")
    by_power = listed.groupBy(F.floor(F.log2("n") * 8).alias("p")).agg(F.count("*").alias("c"), F.min("n").alias("n")).collect()  # at most 8 rows a power of two
    taken, least = 0, None
    for row in sorted(by_power, key=lambda r: -r["p"]):
        taken += row["c"]
        if taken > most:
            break
        least = row["n"]
    if least is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    table = listed.filter(F.col("n") >= least).toArrow()  # at most ``most`` rows
    return table.column("key").to_numpy(), table.column("n").to_numpy()


def global_order(texts: DataFrame, words: int, fragments: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The most frequent keys (ascending), their frequency and fragment, and how many fragments the other shingles fill.

    Shingles are ordered by frequency (0 for all that aren't listed), then by hash.
    """
    counts = written(frequencies(texts, words), "frequencies")
    total = counts.filter("key = -1").agg(F.coalesce(F.sum("n"), F.lit(0))).collect()[0][0]
    keys, n = most_frequent(counts, FREQUENT)
    if not len(keys):
        none = np.zeros(0, np.int64)
        return none, none, none, fragments
    by = np.lexsort((keys, n))
    often = int(n.sum())
    seldom = max(1, min(fragments - 1, round(fragments * (total - often) / max(1, total))))
    fragment = np.empty(len(keys), np.int64)
    fragment[by] = seldom + np.minimum((np.cumsum(n[by]) - n[by]) * (fragments - seldom) // max(1, often), fragments - seldom - 1)
    order = np.argsort(keys)
    return keys[order], n[order], fragment[order], seldom


class Listed:
    """Values of listed keys; a table of the keys' upper bits spares most shingles the search."""

    BITS = 23

    def __init__(self, keys: np.ndarray, values: np.ndarray, other: int):
        self.keys, self.values, self.other = keys, values, other
        self.some = np.zeros(1 << self.BITS, bool)
        self.some[keys >> (48 - self.BITS)] = True

    def of(self, sets: np.ndarray) -> np.ndarray:
        """The listed value of each shingle, or ``other``."""
        out = np.full(len(sets), self.other, np.int64)
        at = np.flatnonzero(self.some[sets >> np.uint64(64 - self.BITS)])
        if len(at):
            short = (sets[at] >> np.uint64(16)).astype(np.int64)
            place = np.minimum(np.searchsorted(self.keys, short), len(self.keys) - 1)
            hit = self.keys[place] == short
            out[at[hit]] = self.values[place[hit]]
        return out


def _parities(own: np.ndarray) -> list[int]:
    slots = np.bincount((own & np.uint64(64 * PARITIES - 1)).astype(np.int64), minlength=64 * PARITIES) & 1
    return np.packbits(slots).view(np.int64).tolist()


def profiles(texts: DataFrame, words: int, least: int, order: Broadcast) -> DataFrame:
    """``k, h, digest, n, parities, prefix`` of every text: digest and size of its set, parities of its members, its first members."""
    kind = texts.schema["k"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, often, _, _ = order.value
        shingles, listed = Shingles(words), Listed(keys, often, 0)
        for batch in batches:
            for at in range(0, len(batch), SLICE):
                part, digest, size, parities, prefix = batch.slice(at, SLICE), [], [], [], []
                for t in part.column("t"):
                    own = shingles.of(t.as_py())
                    digest.append(xxhash.xxh3_128_digest(own.tobytes()))
                    size.append(len(own))
                    parities.append(_parities(own))
                    take = first_of(len(own), least)
                    prefix.append(own[np.argsort(listed.of(own), kind="stable")[:take]].view(np.int64))
                made = [pa.array(digest, pa.binary()), pa.array(size, pa.int32()), pa.array(parities, pa.list_(pa.int64())), pa.array(prefix, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([part.column("k"), part.column("h"), *made], ["k", "h", "digest", "n", "parities", "prefix"])

    return texts.select("k", "h", "t").mapInArrow(run, f"k {kind}, h bigint, digest binary, n int, parities array<bigint>, prefix array<bigint>")


# -- candidates ------------------------------------------------------------------------


def met(classes: DataFrame) -> DataFrame:
    """``key, id, n, i``: members of prefixes that several classes have in theirs, with their place in it.

    Rows of a key pass one by one, so a key may have any number of them.
    """
    rows = classes.filter("n > 0").select("id", "n", F.posexplode("prefix").alias("i", "key")).select("key", "id", "n", "i")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, before = None, None  # the last row so far, and whether the row before it has its key
        for batch in batches:
            if not len(batch):
                continue
            key = batch.column("key").to_numpy()
            joined = bool(last is not None and last.column("key")[0].as_py() == key[0])
            if last is not None and (before or joined):
                yield last
            same = np.r_[joined, key[1:] == key[:-1]]
            keep = same[:-1] | same[1:]
            yield batch.slice(0, len(batch) - 1).filter(pa.array(keep))
            last, before = batch.slice(len(batch) - 1), bool(same[-1])
        if last is not None and before:
            yield last

    parts = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(run, "key bigint, id bigint, n int, i int")


def _needed(n: Column, m: Column, least: int) -> Column:
    """The least overlap of sets of ``n`` and ``m`` members that are similar enough."""
    return F.ceil((n + m) * least / (100 + least) - 1e-9).cast("bigint")


def _alike(a: str, b: str, least: int) -> Column:
    """Whether sizes and parities of the structs ``a`` and ``b`` allow the similarity."""
    n, m = F.col(f"{a}.n").cast("bigint"), F.col(f"{b}.n").cast("bigint")
    differ = reduce(Column.__add__, [F.bit_count(F.col(f"{a}.p{k}").bitwiseXOR(F.col(f"{b}.p{k}"))) for k in range(PARITIES)])
    return (F.least(n, m) * 100 >= F.greatest(n, m) * least) & (differ <= n + m - 2 * _needed(n, m, least))


#: Centres that every key gets in a round.
CENTRES = ("c0", "c1")


def _open(rows: DataFrame, roots: DataFrame | None, turn: int) -> DataFrame:
    """``key, id, n, i, root``, the key's number of rows and its centres: the rows of keys whose classes aren't all joined.

    A centre is the random id of the key that is least in this turn, with its root and size.
    """
    rooted = rows.select("key", "id", "n", "i")
    if roots is None:
        rooted = rooted.withColumn("root", F.col("id"))
    else:
        rooted = rooted.join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    chosen = [F.min(F.struct(F.xxhash64("id", F.lit(2 * turn + k)).alias("h"), "id", "root", "n")).alias(c) for k, c in enumerate(CENTRES)]
    keys = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("many"), *chosen).filter("low <> high").drop("low", "high")
    return rooted.join(keys, "key")


def _stars(rows: DataFrame, least: int) -> DataFrame:
    """``a, b``: every id of a key (``rows`` of :func:`_open`) with the key's centres, of another root and a size that may be similar."""
    both = rows.select("id", "root", "n", F.explode(F.array(*CENTRES)).alias("c"))
    both = both.filter((F.col("root") != F.col("c.root")) & (F.least("n", "c.n") * 100 >= F.greatest("n", "c.n") * least))
    return both.select(F.least("id", "c.id").alias("a"), F.greatest("id", "c.id").alias("b"))


def _rest(rows: DataFrame) -> DataFrame:
    """``rows`` of :func:`_open` without the centres' own: a centre has been compared with all others of its key."""
    return rows.filter(reduce(Column.__and__, [F.col("id") != F.col(f"{c}.id") for c in CENTRES])).select("key", "id", "n", "i")


def _paired(pairs: DataFrame, short: DataFrame, least: int) -> DataFrame:
    """``a, b, n, m`` of the distinct pairs whose sizes and parities (``short``) allow the similarity."""
    of = lambda c: short.select(F.col("id").alias(c), F.struct("n", *[f"p{k}" for k in range(PARITIES)]).alias(f"of_{c}"))
    found = pairs.distinct().join(of("a"), "a").join(of("b"), "b").filter(_alike("of_a", "of_b", least))
    return found.select("a", "b", F.col("of_a.n").alias("n"), F.col("of_b.n").alias("m"))


def _apart(rows: DataFrame, short: DataFrame, least: int) -> DataFrame:
    """``a, b, n, m``: all pairs of one key and different roots (``rows`` of :func:`_open`) whose sizes, places and parities allow the similarity.

    A key's rows are dealt out by size: sizes of similar sets lie in one class of sizes or
    in neighbouring ones.
    """
    rooted = rows.select("key", "id", "i", "root").join(short, "id")
    size = F.floor(F.log(F.col("n").cast("double")) / math.log(100 / least)).cast("int")
    sized = rooted.withColumn("size", size)
    own = sized.select("key", "size", F.struct(*sized.columns).alias("x"))
    other = sized.select("key", F.explode(F.array(F.col("size") - 1, F.col("size"), F.col("size") + 1)).alias("size"), F.struct(*sized.columns).alias("y"))
    n, m = F.col("x.n").cast("bigint"), F.col("y.n").cast("bigint")
    reach = F.least(n - F.col("x.i"), m - F.col("y.i")) >= _needed(n, m, least)
    on = (own["key"] == other["key"]) & (own["size"] == other["size"]) & (F.col("x.id") < F.col("y.id")) & (F.col("x.root") != F.col("y.root")) & reach & _alike("x", "y", least)
    return own.join(other, on).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), F.col("x.n").alias("n"), F.col("y.n").alias("m")).distinct()


# -- counting --------------------------------------------------------------------------


def segments(texts: DataFrame, classes: DataFrame, pairs: DataFrame, cut: DataFrame, words: int, fragments: int, order: Broadcast) -> DataFrame:
    """``id, fragment, segment`` of the classes that ``pairs`` name and ``cut`` hasn't, from a text of each; on disk, dealt by fragment."""
    fresh = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(cut.select("id"), "id", "left_anti")
    ends = written(fresh.join(classes.select("id", "digest", F.col("one.k").alias("_k"), F.col("one.h").alias("_h")), "id"), "ends")
    if ends.count() <= FEW:
        ends = F.broadcast(ends)  # so the texts aren't shuffled for a few of them
    found = texts.join(ends, (F.col("h") == F.col("_h")) & F.col("k").eqNullSafe(F.col("_k"))).select("id", "digest", "t").dropDuplicates(["id", "t"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, _, fragment, seldom = order.value
        shingles, listed = Shingles(words), Listed(keys, fragment, -1)
        width = np.uint64(-(-(1 << 64) // seldom) if seldom > 1 else (1 << 64) - 1)
        for batch in batches:
            for at in range(0, len(batch), SLICE):
                part, ids, numbers, cut = batch.slice(at, SLICE), [], [], []
                for id_, digest, t in zip(part.column("id").to_pylist(), part.column("digest").to_pylist(), part.column("t"), strict=True):
                    own = shingles.of(t.as_py())
                    if xxhash.xxh3_128_digest(own.tobytes()) != digest:
                        continue
                    of = listed.of(own)
                    of = np.where(of < 0, np.minimum(own // width, np.uint64(seldom - 1)).astype(np.int64), of)
                    for f in np.unique(of).tolist():
                        ids.append(id_)
                        numbers.append(f)
                        cut.append(own[of == f].view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(numbers, pa.int32()), pa.array(cut, pa.list_(pa.int64()))], ["id", "fragment", "segment"])

    return written(found.mapInArrow(run, "id bigint, fragment int, segment array<bigint>"), "segments", partition_by="fragment")


def similar(pairs: DataFrame, cut: DataFrame, fragments: int, least: int) -> DataFrame:
    """``a, b`` of the ``pairs (a, b, n, m)`` that are similar: overlaps are counted fragment by fragment and summed.

    After each fragment a pair goes whose segments differ by more than similar sets may.
    """
    n, m = F.col("n").cast("bigint"), F.col("m").cast("bigint")
    left = pairs.select("a", "b", n.alias("n"), m.alias("m"), F.lit(0).cast("bigint").alias("overlap"), F.lit(0).cast("bigint").alias("differ"))
    for f in range(fragments):
        own = cut.filter(F.col("fragment") == f)
        both = left.join(own.select(F.col("id").alias("a"), F.col("segment").alias("x")), "a", "left").join(own.select(F.col("id").alias("b"), F.col("segment").alias("y")), "b", "left")
        size = lambda c: F.when(F.col(c).isNull(), 0).otherwise(F.size(c))
        shared = F.when(F.col("x").isNull() | F.col("y").isNull(), 0).otherwise(F.size(F.array_intersect("x", "y"))).cast("bigint")
        counted = both.select("a", "b", "n", "m", (F.col("overlap") + shared).alias("overlap"), (F.col("differ") + size("x") + size("y") - 2 * shared).alias("differ"))
        left = written(counted.filter(F.col("differ") <= n + m - 2 * _needed(n, m, least)), "overlaps")
    return left.filter(F.col("overlap") * 100 >= (n + m - F.col("overlap")) * least).select("a", "b")


def joined(docs: DataFrame, words: int = WORDS, least: int = LEAST, fragments: int = FRAGMENTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id``: the groups of documents whose sets of word shingles have a Jaccard similarity of ``least`` per cent.

    Texts are compared without regard to the case of A-Z, by 64-bit hashes of shingles.
    A text with fewer words is one shingle; one without words (null ones too) has an empty
    set and is linked with nothing, not even its like.  ``component_id`` is the least id
    reachable.  Rows with a null id take part, but name no component (null if there is no
    other); repeated rows stay.  An empty table gives an empty table.
    """
    spark = docs.sparkSession
    texts = pick(docs, k=id_col, t=text_col).withColumn("h", F.xxhash64("t"))
    order = spark.sparkContext.broadcast(global_order(texts, words, fragments))
    every = written(profiles(texts, words, least, order), "profiles")
    of = every.filter("n > 0").groupBy("digest").agg(F.min("k").alias("least"), F.min(F.struct("k", "h")).alias("one"), *[F.first(c).alias(c) for c in ("n", "parities", "prefix")])
    classes = written(of.withColumn("id", F.monotonically_increasing_id()), "classes")
    short = classes.select("id", "n", *[F.get("parities", F.lit(k)).alias(f"p{k}") for k in range(PARITIES)])
    rows = written(met(classes), "met")
    edges, tested = spark.createDataFrame([], "a bigint, b bigint"), spark.createDataFrame([], "a bigint, b bigint")
    cut, roots = spark.createDataFrame([], "id bigint, fragment int, segment array<bigint>"), None
    turn, last, most = 0, False, None
    while not last:
        left = written(_open(rows, roots, turn), "open")
        n_rows, meetings = left.agg(F.count("*"), F.coalesce(F.sum(F.col("many") - 1), F.lit(0)) / 2).collect()[0]
        most = MEETINGS * n_rows if most is None else most
        last = turn == STARS or meetings <= most  # turn is STARS, too, if a round found nothing: then all that is left
        rows = _rest(left)
        pairs = _apart(left, short, least) if last else _paired(_stars(left, least), short, least)
        pairs = written(pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
        if not pairs.limit(1).count():
            turn = STARS
            continue
        turn += 1
        cut = cut.unionByName(segments(texts, classes, pairs, cut, words, fragments, order))
        found = written(similar(pairs, cut, fragments, least), "edges")
        tested = tested.union(pairs.select("a", "b"))
        if found.limit(1).count():
            edges = edges.union(found)
            roots = components(edges)
        else:
            turn = STARS
    rooted = classes.select("id", "digest", "least")
    if roots is None:
        rooted = rooted.withColumn("root", F.col("id"))
    else:
        rooted = rooted.join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    groups = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    found = rooted.join(groups, "root").select("digest", "component_id")
    linked = every.select("k", "digest", "n").join(found, "digest", "left")
    return linked.select(F.col("k").alias(id_col), F.col("n").cast("bigint").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("k")).alias("component_id"))


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i:i + {WORDS - 1}], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - {WORDS - 2}))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= {LEAST} * (any_value(x.n) + any_value(y.n) - count(*))),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a)
SELECT doc_id, coalesce(any_value(n), 0) AS n_shingles, min(b) AS component_id FROM documents LEFT JOIN n USING (doc_id) JOIN r ON r.a = doc_id GROUP BY doc_id"""
