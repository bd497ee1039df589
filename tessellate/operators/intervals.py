"""Joins of intervals that overlap, on grids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..sources.storage import fresh_path, materialized

#: A level's cells are so many times as wide as those of the level below, as a power of two.
STEP = 3
LEVELS = 21
#: Rows of a cell beyond which it is dealt out over several tasks.
HOT = 50_000
#: Running sums are made in cells of so many positions, as a power of two, and those of cells likewise.
RUN = 16


def _level(length: Column) -> Column:
    """The lowest level whose cells are at least as wide as the interval."""
    level = F.lit(LEVELS - 1)
    for k in reversed(range(LEVELS - 1)):
        level = F.when(length <= (1 << (STEP * k)), F.lit(k)).otherwise(level)
    return level


def _touched(rows: DataFrame, level: Column) -> DataFrame:
    """A row for each cell of the level that the interval touches: one or two at its own level and above it."""
    bits = (level * STEP).cast("int")
    shift = lambda x: F.call_function("shiftright", x, bits)
    return rows.withColumn("_cell", F.explode(F.sequence(shift(F.col("_s")), shift(F.greatest(F.col("_s"), F.col("_e") - 1)))))


def _met(home: DataFrame, probe: DataFrame, keys: list[str], strict: bool, hot: int) -> DataFrame:
    """Pairs of a home row and a probe row of one cell that overlap, each once: in the cell where the later of them starts.

    ``strict`` leaves out probes of the home's own level.
    """
    on = [*keys, "_level", "_cell"]
    many = probe.groupBy(*on).agg(F.ceil(F.count("*") / hot).cast("int").alias("_parts")).filter("_parts > 1")
    parts = F.coalesce("_parts", F.lit(1))
    probe = probe.join(many, on, "left").withColumn("_part", F.pmod(F.xxhash64("_row"), parts).cast("int")).select(*on, "_part", F.col("_row").alias("_b"), F.col("_own").alias("_b_own"), F.col("_s").alias("_b_s"), F.col("_e").alias("_b_e"))
    home = home.join(many, on, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).select(*on, "_part", F.col("_row").alias("_a"), F.col("_s").alias("_a_s"), F.col("_e").alias("_a_e"))
    later = F.call_function("shiftright", F.greatest("_a_s", "_b_s"), (F.col("_level") * STEP).cast("int"))
    hit = text.overlaps(F.col("_a_s"), F.col("_a_e"), F.col("_b_s"), F.col("_b_e")) & (later == F.col("_cell"))
    return home.join(probe, [*on, "_part"]).filter(hit & (F.col("_b_own") < F.col("_level") if strict else F.lit(True))).select("_a", "_b")


def overlapping(left: DataFrame, right: DataFrame, keys: list[str], start: str = "start", end: str = "end", hot: int = HOT) -> DataFrame:
    """``left, right``: structs of all pairs of rows of equal ``keys`` whose half-open intervals overlap.

    Works where keys alone select little, down to one key for all rows.  Intervals live on
    grids, each at the level whose cells are as wide as it or up to eight times wider, so a
    row is in two cells at most; against longer intervals it is looked up at their levels.
    A pair meets in one cell only, and what meets overlaps with fair odds, so the work is
    that of reading the input once a level plus about that of the result.  Cells with many
    rows are dealt out over tasks.  Positions are whole numbers; rows with a null in a key,
    start or end, or that end before they start, overlap nothing.
    """

    def placed(rows: DataFrame) -> DataFrame:
        s, e = F.col(start).cast("bigint"), F.col(end).cast("bigint")
        known = rows.filter(F.col(start).isNotNull() & F.col(end).isNotNull() & (F.col(end) >= F.col(start)))
        found = known.select(*[F.col(k) for k in keys], F.struct(*[F.col(c) for c in rows.columns]).alias("_row"), s.alias("_s"), e.alias("_e"))
        return found.withColumn("_own", _level(F.col("_e") - F.col("_s")))

    a, b = placed(left), placed(right)
    levels = a.select("_own").distinct().union(b.select("_own").distinct()).distinct()
    used = sorted(r[0] for r in levels.collect())  # at most LEVELS numbers
    above = F.filter(F.array(*[F.lit(k) for k in used]) if used else F.array().cast("array<int>"), lambda k: k >= F.col("_own"))
    home = lambda rows: _touched(rows.withColumn("_level", F.col("_own")), F.col("_level"))
    probe = lambda rows: _touched(rows.withColumn("_level", F.explode(above)), F.col("_level"))
    one = _met(home(a), probe(b), keys, False, hot).select(F.col("_a").alias("left"), F.col("_b").alias("right"))
    other = _met(home(b), probe(a), keys, True, hot).select(F.col("_b").alias("left"), F.col("_a").alias("right"))
    return one.unionAll(other)


def _running(sums: DataFrame, keys: list[str], measures: list[str], low: int, high: int) -> DataFrame:
    """``sums`` (a row for each ``keys, _p``) with ``_to…``: the sums of each measure over all rows of the keys up to ``_p``.

    A window has the rows of one cell; what comes before a cell is the running sum over cells,
    made in the same way.  Positions are from ``low`` to ``high``.
    """
    over = lambda *by: Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)
    running = lambda rows, *by: rows.select("*", *[F.sum(m).over(over(*by)).alias(f"_to{m}") for m in measures])
    if high - low < 1 << RUN:
        return running(sums, *keys)
    celled = sums.withColumn("_cell", F.call_function("shiftright", F.col("_p"), F.lit(RUN)))
    cells = celled.groupBy(*keys, F.col("_cell").alias("_p")).agg(*[F.sum(m).alias(m) for m in measures])
    before = _running(cells, keys, measures, low >> RUN, high >> RUN).select(*keys, F.col("_p").alias("_cell"), *[(F.col(f"_to{m}") - F.col(m)).alias(f"_before{m}") for m in measures])
    found = running(celled, *keys, "_cell").join(before, [*keys, "_cell"])
    return found.select(*sums.columns, *[(F.col(f"_to{m}") + F.col(f"_before{m}")).alias(f"_to{m}") for m in measures])


def overlap_counts(left: DataFrame, right: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """The rows of ``left`` that overlap any row of ``right``, with their number ``n``: :func:`overlapping`, counted without its pairs.

    An interval overlaps all that start before its end, less those that end at its start or
    before; so running sums of starts and ends by position are enough, and the work is that
    of a few shuffles of the input, however many pairs there are.  They are kept on disk by
    position, as both ends of a row look them up.
    """
    spark = left.sparkSession

    def placed(rows: DataFrame) -> DataFrame:
        known = rows.filter(F.col(start).isNotNull() & F.col(end).isNotNull() & (F.col(end) >= F.col(start)) & reduce(Column.__and__, [F.col(k).isNotNull() for k in keys], F.lit(True)))
        return known.withColumns({"_s": F.col(start).cast("bigint"), "_e": F.col(end).cast("bigint")})

    def of(rows: DataFrame, counted: int) -> DataFrame:
        empty = F.when(F.col("_s") == F.col("_e"), counted).otherwise(0)
        point = lambda p, *numbers: F.struct(F.col(p).alias("_p"), *[F.lit(x).cast("bigint").alias(c) for c, x in zip(("_starts", "_ends", "_empty"), numbers, strict=True)])
        return rows.select(*keys, F.inline(F.array(point("_s", counted, 0, empty), point("_e", 0, counted, 0))))

    a, b = placed(left), placed(right)
    points = of(b, 1) if left.sameSemantics(right) else of(b, 1).unionAll(of(a, 0))
    sums = materialized(points.groupBy(*keys, "_p").agg(*[F.sum(m).alias(m) for m in ("_starts", "_ends", "_empty")]), fresh_path(spark, "points"))
    low, high = sums.agg(F.min("_p"), F.max("_p")).first()
    if low is None:
        return left.limit(0).withColumn("n", F.lit(0).cast("bigint"))
    to = materialized(_running(sums, keys, ["_starts", "_ends"], low, high), fresh_path(spark, "running"))
    first = to.select(*keys, F.col("_p").alias("_s"), F.col("_to_ends").alias("_gone"), F.col("_empty").alias("_none"))
    last = to.select(*keys, F.col("_p").alias("_e"), (F.col("_to_starts") - F.col("_starts")).alias("_come"))
    n = F.col("_come") - F.col("_gone") + F.when(F.col("_s") == F.col("_e"), F.col("_none")).otherwise(0)
    return a.join(first, [*keys, "_s"]).join(last, [*keys, "_e"]).select(*left.columns, n.alias("n")).filter("n > 0")
