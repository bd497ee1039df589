"""Document fingerprints: threshold-scaled sketches of word shingles, in SQL functions only.

Every shingle hash below a fixed fraction of the 64-bit range is kept, so a sketch grows
with its document, two sketches merge by union, and containment can be estimated between
documents of very different lengths.  A document with words but no hash that low keeps
its least hash instead.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import pick

WORDS = 5
#: One of so many hashes is kept.
SCALE = 8
#: At most about so many rows are sampled to cut the documents into ranges; bounds what reaches the driver.
SAMPLE = 65_536


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


#: ASCII white space, as characters and as a pattern of runs.
BLANKS, BLANK_RUN = " \t\n\x0b\f\r", r"[\x20\x09-\x0D]+"


def split_words(text: Column) -> Column:
    """Lower-cased words of a text that has some: runs of anything but ASCII white space.

    Where single blanks are the only white space, a plain split does, which is several times faster.
    """
    odd = lambda bare: reduce(Column.__or__, [bare.contains(b) for b in ("  ", *BLANKS[1:])])
    return let(F.btrim(F.lower(text), F.lit(BLANKS)), lambda bare: F.when(odd(bare), F.split(bare, BLANK_RUN)).otherwise(F.split(bare, " ")))


def words_of(text: Column) -> Column:
    """Words of any text; none if it has none."""
    return F.array_remove(split_words(text), "")


def shingle_hashes(words: Column, size: int = WORDS) -> Column:
    """Hashes of all word shingles; fewer words make one shingle, none make none."""
    return let(
        words,
        lambda w: F.when(F.size(w) == 0, F.array().cast("array<bigint>")).otherwise(
            F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - size + 1, F.lit(1))), lambda i: F.xxhash64(F.slice(w, i, size)))
        ),
    )


def sketch(text: Column, size: int = WORDS, scale: int = SCALE) -> Column:
    """The sketch of a text, ascending; empty for null texts and texts without words."""
    low = F.lit(-(1 << 63) + (1 << 64) // scale)
    hashes = shingle_hashes(words_of(F.coalesce(text, F.lit(""))), size)
    return let(
        hashes,
        lambda all_: let(
            F.filter(all_, lambda h: h < low),
            lambda kept: F.when(F.size(kept) > 0, F.array_sort(F.array_distinct(kept))).when(F.size(all_) > 0, F.array(F.array_min(all_))).otherwise(kept),
        ),
    )


def merged(sketches: Column) -> Column:
    """Aggregate: the sketch of all documents of a group taken together."""
    return F.array_sort(F.array_distinct(F.flatten(F.collect_set(sketches))))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of ``a``'s shingles that ``b`` has; 1 if ``a`` has none."""
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of the shingle sets; 1 if both are empty."""
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def as_text(sketch_: Column) -> Column:
    """Sixteen hex digits for each kept hash, ascending by signed value."""
    return F.array_join(F.transform(sketch_, lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))), "")


def _place(value: Column, bounds: Column) -> Column:
    """How many of the ascending ``bounds`` are at most ``value``, by halving."""
    steps = F.array(*[F.lit(1 << j) for j in reversed(range(SAMPLE.bit_length()))])
    reached = lambda at, step: F.coalesce(F.get(bounds, at + step - 1) <= value, F.lit(False))
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(reached(at, step), at + step).otherwise(at))


def with_next(docs: DataFrame, rows_a_range: int = 2000) -> DataFrame:
    """``docs (k, t)`` with ``key``, ``range`` and ``guest``: dealt into ranges of the order, neighbours complete.

    The order is that of ``key``: id, then a hash of the text, descending, null ids last.
    Bounds are quantiles of a sample, so ranges have about ``rows_a_range`` rows (more beyond
    ``SAMPLE`` ranges) however the ids lie; only rows equal in id and text share one for sure.
    The first rows of a range are also guests of the range before, and the first of all
    guests of the last, so every row finds its successor within its range.
    """
    spark = docs.sparkSession
    docs = docs.withColumn("key", F.struct("k", F.xxhash64("t").alias("h")))
    rows = docs.count()
    wanted = max(1, min(SAMPLE, rows // rows_a_range))
    sampled = docs.select("key").sample(min(1.0, SAMPLE / 2 / max(1, rows)), seed=7).orderBy("key").collect() if wanted > 1 else []
    bounds = sorted({len(sampled) * j // wanted for j in range(1, wanted)})
    bounds = [sampled[j] for j in bounds if j < len(sampled)]
    table = spark.createDataFrame(bounds, docs.select("key").schema).agg(F.array_sort(F.collect_set("key"))).scalar()
    dealt = docs.withColumn("_bounds", table).withColumn("range", _place(F.col("key"), F.col("_bounds"))).drop("_bounds")
    tops = sorted((r["range"], r["top"]) for r in dealt.groupBy("range").agg(F.max("key").alias("top")).collect())  # a row a range
    # The top of a range follows the last row of the range above; the first row of all follows the last of the lowest.
    hosts = [(top, tops[(j + 1) % len(tops)][0]) for j, (_, top) in enumerate(tops)]
    kind = docs.schema["key"].dataType.simpleString()
    of_top = F.broadcast(spark.createDataFrame(hosts, f"_top {kind}, _host int"))
    found = dealt.join(of_top, F.col("key").eqNullSafe(F.col("_top")), "left")
    own, guest = F.struct(F.col("range"), F.lit(False).alias("guest")), F.struct(F.col("_host").alias("range"), F.lit(True).alias("guest"))
    to = F.explode(F.when(F.col("_host").isNull(), F.array(own)).otherwise(F.array(own, guest))).alias("_to")
    return found.select("k", "t", "key", to).select("k", "t", "key", "_to.range", "_to.guest")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every whole text and of its edited text, with their likeness.

    The edited text has its last floor(n/2) code points replaced by the first as many (or
    all) of the next document in descending order of ids; the last document's next is the
    first.  Null ids come last; rows of one id are ordered by a hash of their text; a null
    text counts as empty; an only document is its own next.  An empty table gives an empty
    table.
    """
    docs = pick(docs, k=id_col, t=text_col).withColumn("t", F.coalesce("t", F.lit("")))
    dealt = with_next(docs).repartition("range").withColumn("s", sketch(F.col("t")))
    after = Window.partitionBy("range").orderBy("guest", F.desc("key"), F.desc("t"))
    paired = dealt.withColumn("_next", F.lead(F.struct("t", "s")).over(after)).filter(~F.col("guest"))
    n, half = F.length("t"), F.floor(F.length("t") / 2).cast("int")
    edited = F.concat(F.substring("t", F.lit(1), n - half), F.substring("_next.t", F.lit(1), half))
    paired = paired.select("k", "s", n.cast("bigint").alias("n"), edited.alias("e"), F.col("_next.s").alias("after"))
    paired = paired.withColumn("es", sketch(F.col("e")))
    return paired.select(
        F.col("k").alias(id_col),
        F.col("n").alias("n_chars"),
        F.sha2(F.col("e").cast("binary"), 256).alias("edited_sha256"),
        as_text(F.col("s")).alias("fingerprint"),
        as_text(F.col("es")).alias("edited_fingerprint"),
        likeness(F.col("s"), F.col("es")).alias("near_edited"),
        likeness(F.col("s"), F.col("after")).alias("near_next"),
        containment(F.col("es"), F.col("s")).alias("edited_in_text"),
    )
