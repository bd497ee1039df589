"""SimHash fingerprints and near-duplicate groups by a Gray-order hierarchical index.

Fingerprints within ``max_bits`` differing bits agree on at least ``same`` of
``max_bits + same`` bands, so rows meet in buckets keyed by a choice of bands; buckets
that get too large are split by a further band of the bits that are left.  In a bucket
the distinct fingerprints are sorted by Gray rank, which brings those with long common
patterns together; runs of them form nodes that keep the bits all members share (mask and
pattern), runs of nodes form upper nodes.  The search descends over pairs of nodes and
drops a pair as soon as the shared bits alone differ too often, and also where both sides
are one component already.  It returns links that span every component of a bucket, never
all pairs of a group; Spark joins the buckets' links into components.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forgotten, numbered, pick, written, written_at
from .components import components
from .ngram_join import frequencies, most_frequent

SEED = 42
FANOUT = 8
#: Pairs of nodes compared at a time; bounds the search's memory.
SLICE = 200_000
#: Rows of a bucket beyond which it is split by further bands.
BUCKET_ROWS = 4096
#: Shingles whose frequency orders them, at most: the most frequent ones.  All others come before them, by hash.
COMMON = 200_000
#: Pairs of near-duplicates are verified in so many parts, one after another.
VERIFY_PARTS = 4


# -- fingerprints ----------------------------------------------------------------------


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """64-bit hashes of a text's word shingles in order, repeats included.

    ASCII letters are lower-cased, words are runs of anything but ASCII white space; fewer
    words than a shingle's make one shingle.
    """
    parts = (text or "").encode().lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    flat = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    first = np.r_[0, ends[:-1] + 1]
    take = max(1, len(parts) - words + 1)
    starts, stops = first[:take].tolist(), ends[min(words, len(parts)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(flat[s:e], SEED) for s, e in zip(starts, stops, strict=True)), np.uint64, take)


def voted(hashes: np.ndarray) -> int:
    """64-bit SimHash of shingle hashes; none: 0."""
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 100_000):
        h = hashes[at : at + 100_000].astype(">u8")
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > len(hashes)).tobytes(), "big")


def fingerprint(text: str | None, words: int) -> int:
    """64-bit SimHash over word shingles (:func:`shingle_hashes`), repeats included; no words: 0."""
    return voted(shingle_hashes(text, words))


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp`` (64 bits as a signed long) of every whole text; null and empty texts have 0."""
    kind = docs.schema.fields[docs.columns.index(id_col)].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), words) for t in batch.column("t")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array(found)], ["doc_id", "fp"])

    return pick(docs, k=id_col, t=text_col).mapInArrow(run, f"doc_id {kind}, fp bigint")


# -- the index in a bucket -------------------------------------------------------------


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of each number in the sequence of Gray codes."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


class _Union:
    """Components over items; ``join`` keeps the links that joined two of them."""

    def __init__(self, n: int):
        self.label, self.links = np.arange(n), []

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            a, b = self.label[i], self.label[j]
            apart = a != b
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            if not len(i):
                return
            high, at = np.unique(np.maximum(a, b), return_index=True)
            self.links.append((i[at], j[at]))
            parent = np.arange(len(self.label))
            parent[high] = np.minimum(a, b)[at]
            while not np.array_equal(up := parent[parent], parent):
                parent = up
            self.label = parent[self.label]


def _pairs(a: np.ndarray, b: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of children of the node pairs (a, b), the second never before the first."""
    n = size[a] * size[b]
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    wide = np.repeat(size[b], n)
    i, j = np.repeat(start[a], n) + k // wide, np.repeat(start[b], n) + k % wide
    keep = i <= j
    return i[keep], j[keep]


def spanning_links(fps: np.ndarray, group: np.ndarray, tiers: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Links (index pairs) that span the components of each group under ``tiers[-1]`` bits.

    Links of a lower tier are taken before those of a higher one.  Two equal fingerprints
    of a group are linked too.
    """
    order = np.lexsort((gray_rank(fps), group))
    alone = np.r_[True, group[order[1:]] != group[order[:-1]]][: len(order)]
    order = order[~(alone & np.r_[alone[1:], True][: len(order)])]
    fps, group = fps[order], group[order]
    levels = [(fps, np.full(len(fps), ~np.uint64(0)), group, None, None)]
    while len(fps):
        pattern, mask, owner, _, _ = levels[-1]
        first = np.r_[True, owner[1:] != owner[:-1]]
        if first.all():
            break
        within = np.arange(len(owner)) - np.maximum.accumulate(np.where(first, np.arange(len(owner)), 0))
        start = np.flatnonzero(within % FANOUT == 0)
        size = np.diff(np.r_[start, len(owner)])
        ones, zeros = np.bitwise_and.reduceat(pattern & mask, start), np.bitwise_or.reduceat(pattern | ~mask, start)
        shared = ones | ~zeros  # bits that are 1 in all, or 0 in all
        levels.append((ones, shared, owner[start], start, size))
    union = _Union(len(fps))
    top = np.arange(len(levels[-1][0]))
    for bits in tiers if len(top) else ():
        stack = [(len(levels) - 1, top, top)]
        while stack:
            level, a, b = stack.pop()
            if len(a) > SLICE // FANOUT**2:
                half = len(a) // 2
                stack += [(level, a[half:], b[half:]), (level, a[:half], b[:half])]
                continue
            if level == 1:  # both nodes one and the same component: nothing to gain
                _, _, _, start, size = levels[1]
                least, most = np.minimum.reduceat(union.label, start), np.maximum.reduceat(union.label, start)
                open_ = (least[a] != most[a]) | (least[b] != most[b]) | (least[a] != least[b])
                a, b = a[open_], b[open_]
            i, j = _pairs(a, b, levels[level][3], levels[level][4])
            pattern, mask = levels[level - 1][:2]
            near = np.bitwise_count((pattern[i] ^ pattern[j]) & mask[i] & mask[j]) <= bits
            i, j = i[near], j[near]
            if level == 1:
                union.join(i[i != j], j[i != j])
            elif len(i):
                stack.append((level - 1, i, j))
    if not union.links:
        return np.empty(0, int), np.empty(0, int)
    i, j = (np.concatenate(x) for x in zip(*union.links, strict=True))
    return order[i], order[j]


# -- buckets ---------------------------------------------------------------------------


def band_masks(bands: int, bits: range = range(64)) -> list[int]:
    """The given bits dealt into ``bands`` runs."""
    bits, out = list(bits), []
    for k in range(bands):
        run = bits[k * len(bits) // bands : (k + 1) * len(bits) // bands]
        out.append(sum(1 << b for b in run))
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _keyed(classes: DataFrame, max_bits: int, same: int) -> DataFrame:
    """``key, fp``: each fingerprint in the buckets of all choices of ``same`` bands; large buckets split further."""
    masks = [sum(c) for c in combinations(band_masks(max_bits + same), same)]
    key = lambda t, m, f: F.xxhash64(F.lit(t), f.bitwiseAND(F.lit(_signed(m))))
    tables = F.array(*[F.struct(F.lit(t).alias("table"), key(t, m, F.col("fp")).alias("key")) for t, m in enumerate(masks)])
    rows = classes.select("fp", F.explode(tables).alias("x")).select("fp", "x.table", "x.key")
    # At most rows / BUCKET_ROWS buckets are large.
    large = rows.groupBy("key").count().filter(F.col("count") > BUCKET_ROWS).select("key", F.lit(True).alias("large"))
    rows = rows.join(large, "key", "left")
    finer = []
    for m in masks:
        rest = [b for b in range(64) if not m >> b & 1]
        finer.append(F.array(*[F.lit(_signed(x)) for x in band_masks(max_bits + 1, rest)]))
    sub = F.transform(F.element_at(F.array(*finer), F.col("table") + 1), lambda m: F.xxhash64("key", m, F.col("fp").bitwiseAND(m)))
    keys = F.when(F.col("large"), sub).otherwise(F.array("key"))
    return rows.select(F.explode(keys).alias("key"), "fp")


def links(classes: DataFrame, max_bits: int, same: int = 1, tiers: tuple[int, ...] | None = None) -> DataFrame:
    """``a, b``: links between distinct fingerprints (``classes.fp``) that span all components.

    Links join fingerprints of at most ``max_bits`` differing bits; with ``tiers`` closer
    ones are preferred.
    """
    tiers = tiers or (max_bits,)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def found(keys, fps):
            edges = np.r_[True, keys[1:] != keys[:-1]]
            i, j = spanning_links(fps.view(np.uint64), np.cumsum(edges), tiers)
            return pa.RecordBatch.from_arrays([pa.array(fps[i]), pa.array(fps[j])], ["a", "b"])

        for batch in batches:  # sorted by key: whole buckets are searched together
            if not len(batch):
                continue
            held.append((batch.column("key").to_numpy(), batch.column("fp").to_numpy()))
            last = held[-1][0][-1]
            if held[-1][0][0] == last and len(held) > 1 and held[0][0][0] == last:
                continue
            keys, fps = (np.concatenate(x) for x in zip(*held, strict=True))
            cut = int(np.searchsorted(keys, last))
            if cut:
                yield found(keys[:cut], fps[:cut])
            held = [(keys[cut:], fps[cut:])]
        if held:
            yield found(*(np.concatenate(x) for x in zip(*held, strict=True)))

    rows = _keyed(classes, max_bits, same)
    partitions = max(8, int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartition(partitions, "key").sortWithinPartitions("key").mapInArrow(run, "a bigint, b bigint").distinct()


def grouped(docs: DataFrame, words: int = 3, max_bits: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint, component_id``: groups of documents linked at ``max_bits`` or fewer bits.

    ``component_id`` is the least id reachable.  Documents without words share fingerprint
    zero and are linked like any other; rows with a null id take part, but name no
    component (a component of null ids only has a null ``component_id``); repeated rows
    stay.  An empty table gives an empty table.
    """
    fps = written(fingerprints(docs, words, id_col, text_col), "fingerprints")
    classes = written(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    roots = components(links(classes, max_bits))
    classes = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    found = classes.select("fp", "root").join(least, "root").select("fp", "component_id")
    text = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return fps.join(found, "fp").select("doc_id", text.alias("fingerprint"), "component_id")


# -- near-duplicates -------------------------------------------------------------------


def _digest(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


def common_shingles(texts: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles (ascending, the upper 48 bits of their hashes), and how many of all documents hold each.

    The counts only order shingles by rarity; any order common to all texts keeps the join exact.
    """
    sets = lambda words: lambda t: np.unique(shingle_hashes(t, words))
    counts, path = written_at(frequencies(texts, words, sets), "frequencies")
    hashes, n = most_frequent(counts, COMMON)
    forgotten(texts.sparkSession, path)
    order = np.argsort(hashes)
    return hashes[order].astype(np.uint64), n[order]


def profiles(texts: DataFrame, words: int, least: float) -> DataFrame:
    """``k, fp, digest, n, bits, prefix`` of every text ``t``, from its set of shingles.

    ``n`` is the set's size, ``bits`` the parities of its members in 256 slots, ``prefix`` its
    rarest members: two sets of Jaccard similarity ``least`` or more share one of those.
    """
    sent = texts.sparkSession.sparkContext.broadcast(common_shingles(texts, words))
    kind = texts.schema.fields[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = sent.value
        for batch in batches:
            for at in range(0, len(batch), 512):
                part, rows = batch.slice(at, 512), []
                for t in part.column("t"):
                    hashes = shingle_hashes(t.as_py(), words)
                    own = np.unique(hashes)
                    level = np.zeros(len(own), np.int64)
                    if len(known):
                        short = own >> np.uint64(16)
                        place = np.minimum(np.searchsorted(known, short), len(known) - 1)
                        level = np.where(known[place] == short, counts[place], 0)
                    take = len(own) - math.ceil(least * len(own) - 1e-9) + 1 if len(own) else 0
                    bits = np.packbits(np.bincount((own & np.uint64(255)).astype(np.int64), minlength=256) & 1).tobytes()
                    prefix = own[np.lexsort((own, level))[:take]].view(np.int64)
                    rows.append((voted(hashes), _digest(own), len(own), bits, prefix))
                fp, digest, n, bits, prefix = zip(*rows, strict=True) if rows else ((),) * 5
                columns = [pa.array(np.array(fp, np.uint64).view(np.int64)), pa.array(digest, pa.binary()), pa.array(n, pa.int32()), pa.array(bits, pa.binary()), pa.array(prefix, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([part.column("k"), *columns], ["k", "fp", "digest", "n", "bits", "prefix"])

    return texts.mapInArrow(run, f"k {kind}, fp bigint, digest binary, n int, bits binary, prefix array<bigint>")


def _by_key(rows: DataFrame, found: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``found`` on runs of whole keys of ``rows``, which have ``key`` first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not len(batch):
                continue
            held.append(batch)
            last = batch.column("key")[-1].as_py()
            if held[0].column("key")[0].as_py() == last:
                continue
            whole = pa.Table.from_batches(held).combine_chunks()
            cut = int(np.searchsorted(whole.column("key").to_numpy(), last))
            yield from found(whole.slice(0, cut))
            held = whole.slice(cut).to_batches()
        if held:
            yield from found(pa.Table.from_batches(held))

    partitions = max(8, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartition(partitions, "key").sortWithinPartitions("key").mapInArrow(run, schema)


def shared(rows: DataFrame) -> DataFrame:
    """The rows of ``rows (key, id, n, i)`` whose key another row has too."""

    def found(table: pa.Table) -> Iterator[pa.RecordBatch]:
        key = table.column("key").to_numpy()
        same = key[1:] == key[:-1]
        yield from table.filter(pa.array(np.r_[False, same] | np.r_[same, False])).to_batches()

    return _by_key(rows, found, "key bigint, id bigint, n int, i int")


def possible(rows: DataFrame, least: float) -> DataFrame:
    """``a, b``: all pairs of one key, different roots, and sizes, places and parities that allow ``least``."""
    ratio = least / (1 + least)

    def found(table: pa.Table) -> Iterator[pa.RecordBatch]:
        key, id_, n, i, root = (table.column(c).to_numpy() for c in ("key", "id", "n", "i", "root"))
        bits = np.frombuffer(b"".join(table.column("bits").to_pylist()), np.uint64).reshape(-1, 4)
        edges = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
        for start, stop in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            order = start + np.argsort(n[start:stop], kind="stable")
            sizes = n[order]
            ends = np.searchsorted(sizes, np.floor(sizes / least + 1e-9), "right")
            for at, end in enumerate(ends.tolist()):
                x, y = order[at], order[at + 1 : end]
                y = y[root[y] != root[x]]
                need = np.ceil(ratio * (n[x] + n[y]) - 1e-9)
                ok = np.minimum(n[x] - i[x], n[y] - i[y]) >= need
                y, need = y[ok], need[ok]
                y = y[np.bitwise_count(bits[x] ^ bits[y]).sum(axis=1, dtype=np.int64) <= n[x] + n[y] - 2 * need]
                if len(y):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(id_[x], id_[y])), pa.array(np.maximum(id_[x], id_[y]))], ["a", "b"])

    return _by_key(rows, found, "a bigint, b bigint").distinct()


def verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The ``pairs (a, b)`` whose ``sets (id, shingles)`` have a Jaccard similarity of ``least`` or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = x.values.to_numpy(), y.values.to_numpy()
                both = len(np.intersect1d(x, y, assume_unique=True))
                near.append(both >= least * (len(x) + len(y) - both) - 1e-9)
            yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    parts = []
    for k in range(VERIFY_PARTS):  # pairs carry whole sets here, so one part at a time is on disk
        part = pairs.filter(F.pmod(F.xxhash64("a", "b"), F.lit(VERIFY_PARTS)) == k)
        both = part.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b")
        parts.append(written(both.select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint"), "verified"))
    return reduce(DataFrame.union, parts)


def _pairs_of(rows: DataFrame, a: str, b: str) -> DataFrame:
    return rows.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).filter("a <> b").distinct()


def _stars(rows: DataFrame, round_: int) -> DataFrame:
    """Pairs of every row's id with one id of its key."""
    centre = rows.groupBy("key").agg(F.min(F.struct(F.xxhash64("id", F.lit(round_)).alias("h"), F.col("id").alias("centre"))).alias("c"))
    return _pairs_of(rows.join(centre, "key"), "id", "c.centre")


def plausible(pairs: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """The ``pairs (a, b)`` whose sizes and parities (``classes.n, bits``) allow a similarity of ``least``."""
    ratio = least / (1 + least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = (batch.column(c).to_numpy().astype(np.int64) for c in ("n", "m"))
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(-1, 4) for c in ("x", "y"))
            need = np.ceil(ratio * (n + m) - 1e-9)
            near = (np.minimum(n, m) >= need) & (np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64) <= n + m - 2 * need)
            yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    of = lambda end, n, bits: classes.select(F.col("id").alias(end), F.col("n").alias(n), F.col("bits").alias(bits))
    return pairs.join(of("a", "n", "x"), "a").join(of("b", "m", "y"), "b").select("a", "b", "n", "m", "x", "y").mapInArrow(run, "a bigint, b bigint")


def shingle_sets(texts: DataFrame, classes: DataFrame, pairs: DataFrame, words: int) -> DataFrame:
    """``id, shingles`` of the classes that ``pairs`` name, made anew from a text of each, on disk."""
    ends = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct().join(classes, "id").select("id", "least", "digest")

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.slice(at, 512)
                sets = [np.unique(shingle_hashes(t.as_py(), words)) for t in part.column("t")]
                right = pa.array([_digest(s) == d.as_py() for s, d in zip(sets, part.column("digest"), strict=True)], pa.bool_())
                made = pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column("id"), made], ["id", "shingles"]).filter(right)

    shown = texts.join(ends, texts["k"] == ends["least"]).select("id", "digest", "t").mapInArrow(own, "id bigint, shingles array<bigint>")
    return written(shown.dropDuplicates(["id"]), "sets")


def near_duplicates(docs: DataFrame, words: int = 5, least: float = 0.8, max_bits: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, group_id``: connected groups of documents of Jaccard similarity ``least`` or more.

    The similarity is that of the sets of word shingles (as 64-bit hashes); texts of one set
    are one class.  Classes whose fingerprints are equal or linked at ``max_bits`` (the closest
    first, as in :func:`links`) and classes that share a rare shingle with a common centre are
    verified first, where sizes and parities allow the similarity.  Then every such pair of a
    shared prefix shingle that is still in two groups is verified, so no pair is lost.
    ``group_id`` is the least id of the group; texts without words (null ones too) are one
    group; rows with a null id never give one, and link no others; repeated rows stay.  An
    empty table gives an empty table.
    """
    texts = pick(docs, k=id_col, t=text_col)
    every = written(profiles(texts, words, least), "profiles")
    of = every.groupBy("digest").agg(F.min("k").alias("least"), *[F.first(c).alias(c) for c in ("fp", "n", "bits", "prefix")])
    classes = written(of.withColumn("id", F.monotonically_increasing_id()), "classes")
    named = classes.filter("least IS NOT NULL AND n > 0")
    met = written(shared(named.select("id", "n", F.posexplode("prefix").alias("i", "key")).select("key", "id", "n", "i")), "shared")
    first = named.groupBy("fp").agg(F.min("id").alias("first"))
    equal = _pairs_of(named.select("id", "fp").join(first, "fp"), "id", "first")
    bits = links(first.select("fp"), max_bits, same=2, tiers=(3, max_bits))
    linked = _pairs_of(bits.join(first.select(F.col("fp").alias("a"), F.col("first").alias("x")), "a").join(first.select(F.col("fp").alias("b"), F.col("first").alias("y")), "b"), "x", "y")
    pairs = written(equal.union(linked).union(_stars(met, 0)).union(_stars(met, 1)).distinct(), "pairs")
    tested = written(plausible(pairs, classes, least), "pairs")
    edges = verified(tested, shingle_sets(texts, classes, tested, words), least)
    roots = components(edges)
    rooted = met.join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    apart = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("key")
    met = rooted.join(apart, "key").join(classes.select("id", "bits"), "id").select("key", "id", "n", "i", "root", "bits")
    more = written(possible(met, least).join(tested, ["a", "b"], "left_anti"), "pairs")
    edges = edges.union(verified(more, shingle_sets(texts, classes, more, words), least))
    roots = components(edges)
    classes = classes.select("id", "digest", "least").join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    groups = classes.groupBy("root").agg(F.min("least").alias("group_id"))
    found = classes.select("digest", "root").join(groups, "root").select("digest", "group_id")
    return every.select(F.col("k").alias("doc_id"), "digest").join(found, "digest").select("doc_id", "group_id")


def one_of_each(docs: DataFrame, words: int = 5, least: float = 0.8, max_bits: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without those that are near-duplicates of a document with a lower id; columns as they are.

    Rows with a null id stay; rows of one id are one document and stay or go together.
    """
    groups = near_duplicates(docs, words, least, max_bits, id_col, text_col)
    gone = groups.filter("doc_id > group_id").select(F.col("doc_id").alias("_gone")).distinct()
    plain, (k,) = numbered(docs, id_col)
    return plain.join(gone, k == F.col("_gone"), "left_anti").toDF(*docs.columns)
