"""Merging passes by interval sets (M2, M3), and joins of overlapping intervals (M1)."""

import random
import time

from pyspark.sql import functions as F

from tessellate.functions.intervals import IntervalSet, accepted
from tessellate.operators import extraction, intervals


def plain_accepted(first, later):
    taken, out = [x for x in first if None not in x], []
    for x in later:
        out.append(None in x or not any(x[0] < b and a < x[1] for a, b in taken))
        if out[-1] and None not in x:
            taken.append(x)
    return out


def span(rng, most):
    a = rng.randrange(most)
    return (a, a + rng.choice([0, 1, 1, 2, 5, most // 3])) if rng.random() < 0.9 else rng.choice([(None, 3), (2, None), (None, None)])


def test_m2_accepted_is_the_plain_fold():
    rng = random.Random(2)
    for _ in range(2000):
        most = rng.choice([6, 30, 200])
        first, later = ([span(rng, most) for _ in range(rng.randrange(n))] for n in (8, 15))
        assert accepted(first, later) == plain_accepted(first, later), (first, later)


def test_m2_sets_stay_sorted_and_apart():
    rng, kept = random.Random(3), IntervalSet()
    for _ in range(500):
        a = rng.randrange(10_000)
        kept.add(a, a + rng.randint(1, 30))
        assert all(e <= s for e, s in zip(kept.ends, kept.starts[1:], strict=False)) and all(s < e for s, e in zip(kept.starts, kept.ends, strict=True))


def test_m2_a_document_of_a_hundred_thousand_extractions():
    rng = random.Random(5)
    places = [(a := rng.randrange(3_000_000), a + rng.randint(1, 40)) for _ in range(100_000)]
    began = time.process_time()
    keep = accepted(places[:1000], places[1000:])
    assert time.process_time() - began < 5 and 20_000 < sum(keep) < 99_000


def test_m2_m3_columns(spark):
    item = "array<struct<n: int, char_interval: struct<start_pos: int, end_pos: int>>>"
    rng, rows = random.Random(7), []
    for k in range(50):
        first, later = ([(i, s if rng.random() < 0.9 else None) for i, s in enumerate(span(rng, 40) for _ in range(rng.randrange(6)))] for _ in "ab")
        rows.append((k, first, later))
    rows.append((50, None, None))
    table = spark.createDataFrame(rows, f"k int, first {item}, later {item}")
    found = {r.k: r.merged for r in table.select("k", extraction.merge_passes(F.col("first"), F.col("later")).alias("merged")).collect()}
    for k, first, later in rows[:-1]:
        of = lambda items: [s or (None, None) for _, s in items]
        want = first + [x for x, keep in zip(later, plain_accepted(of(first), of(later)), strict=True) if keep]
        assert [(r.n, r.char_interval and tuple(r.char_interval)) for r in found[k]] == want


def pairs_of(spark, a, b, **options):
    table = lambda rows: spark.createDataFrame(rows, "k string, n int, start bigint, end bigint").repartition(3)
    return sorted((r.left.n, r.right.n) for r in intervals.overlapping(table(a), table(b), ["k"], **options).collect())


def test_m1_overlapping_is_the_plain_join(spark):
    rng = random.Random(8)

    def rows(n):
        out = []
        for k in range(n):
            a = rng.randrange(-500, 3000)
            length = rng.choice([0, 1, 2, 7, 8, 9, 64, 65, 300, 2500])
            out.append((rng.choice("xxxy"), k, a, a + length))
        return [*out, ("x", n, None, 5), ("x", n + 1, 5, None), (None, n + 2, 0, 9), ("x", n + 3, 9, 3), ("x", 0, *out[0][2:])]

    a, b = rows(150), rows(120)
    want = sorted((x[1], y[1]) for x in a for y in b if x[0] == y[0] and None not in x and None not in y and x[2] <= x[3] and y[2] <= y[3] and x[2] < y[3] and y[2] < x[3])
    assert pairs_of(spark, a, b) == want == pairs_of(spark, a, b, hot=7)
    assert pairs_of(spark, a, []) == [] == pairs_of(spark, [], [])


def test_m1_one_key_of_a_million_intervals(spark):
    """All of one key, with a few long ones: the pairs are those of a merge count."""
    n = 500_000
    rows = spark.range(n).select(F.lit(1).alias("k"), "id", (F.col("id") * 3 + F.xxhash64("id") % 2).alias("start")).withColumn("end", F.col("start") + F.when(F.col("id") % 100_000 == 5, 30_000).otherwise(F.col("id") % 4))
    found = intervals.overlapping(rows, rows, ["k"]).count()
    starts, ends = (sorted(r[0] for r in rows.filter("start < end").select(c).collect()) for c in ("start", "end"))
    from bisect import bisect_left, bisect_right

    # Overlapping pairs of intervals that aren't empty: those that start before an end, less those that end before a start.
    want = sum(bisect_left(starts, e) for e in ends) - sum(bisect_right(ends, s) for s in starts)
    empty = rows.filter("start = end").select("start")
    inside = intervals.overlapping(rows, rows.filter("start = end"), ["k"]).count()
    both = intervals.overlapping(rows.filter("start = end"), rows.filter("start = end"), ["k"]).count()
    assert found == want + 2 * inside - both and empty.count() > 0


def test_m1_counts_are_those_of_the_pairs_without_making_them(spark):
    rng = random.Random(9)

    def rows(n, far):
        out = []
        for k in range(n):
            a = rng.choice([rng.randrange(-500, 3000), rng.randrange(-far, far)])
            out.append((rng.choice("xxxy"), k, a, a + rng.choice([0, 1, 2, 7, 300, 70_000])))
        return [*out, ("x", n, None, 5), ("x", n + 1, 5, None), (None, n + 2, 0, 9), ("x", n + 3, 9, 3), ("x", 0, *out[0][2:])]

    for far in (40, 1 << 18, 1 << 40):
        a, b = rows(150, far), rows(120, far)
        table = lambda rows: spark.createDataFrame(rows, "k string, n_row int, start bigint, end bigint").repartition(3)
        met = lambda x, y: x[0] == y[0] and None not in x and None not in y and x[2] <= x[3] and y[2] <= y[3] and x[2] < y[3] and y[2] < x[3]
        want = sorted((x[1], n) for x in a if (n := sum(met(x, y) for y in b)))
        found = intervals.overlap_counts(table(a), table(b), ["k"])
        assert sorted((r.n_row, r.n) for r in found.collect()) == want and found.columns == ["k", "n_row", "start", "end", "n"]
    assert intervals.overlap_counts(table([]), table([]), ["k"]).count() == 0 == intervals.overlap_counts(table(a), table([]), ["k"]).count()


def test_m1_counts_of_a_crowd_take_no_pairs(spark):
    """Half a million intervals that all overlap one another are 250 thousand million pairs."""
    n = 500_000
    rows = spark.range(n).select(F.lit(1).alias("k"), "id", F.col("id").alias("start"), (F.col("id") + n).alias("end"))
    found = intervals.overlap_counts(rows, rows, ["k"]).agg(F.count("*"), F.min("n"), F.max("n")).first()
    assert tuple(found) == (n, n, n)
