"""Line deduplication by an exact set-similarity join, in SQL functions only.

A line's tokens are the 64-bit hashes of its distinct lower-cased words; lines of one token
set are one class, known by 128 bits.  Tokens are ordered by rarity: the number of classes
that have a token of the same hash bucket (one for every two classes, at most
``2**FREQUENCY_BITS``), then the hash; any order common to all lines keeps the join exact,
a rarer prefix makes it quick.  Two classes with Jaccard similarity ``t`` or more share a token among the first ``n - ceil(t n) + 1`` of
the larger and the first ``n - ceil(2t/(1+t) n) + 1`` of the smaller; length, position and
the parities of the tokens in 64 slots discard most meetings, and the rest are verified on
whole token sets.

A line goes if its class occurs in an earlier line or is similar to a class that does; order
is (id, line number).  One earlier witness is enough, so the join has two rounds.  In the
first, every class meets a few earlier ones in the crowded buckets among those of its rarest
tokens; that settles nearly all of a large group of near copies.  In the second, classes not
settled yet are joined with all earlier ones.
"""

from __future__ import annotations

from functools import reduce
from math import log2

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bucketed, bucketed_at, forgotten, numbered, pick, written, written_at
from .sketch import BLANKS

#: The frequency table has a bucket for every two classes, but no more than this power of two.
FREQUENCY_BITS = 22
#: Jaccard similarity 4/5, as whole numbers.
NUM, DEN = 4, 5
#: In the first round a class looks at its so many rarest tokens, and there at the classes so many places before it.
RAREST, BEFORE = 6, (1, 2, 3, 4, 6, 8, 12, 16, 24, 32)
#: Only buckets of so many classes or more have a first round; in smaller ones the second has few meetings anyway.
CROWDED = 64
#: Buckets of more classes than this are dealt out in the first round, so that no task has a whole large one.
BUCKET = 4096


def has_words(text: Column) -> Column:
    return F.ltrim(text, F.lit(BLANKS)) != ""


def line_rows(docs: DataFrame) -> DataFrame:
    """``k, pos, line`` of every line of ``docs (k, t)``, lower-cased, with blanks for all other white space.

    A text is looked at once for both, not each of its lines.
    """
    rare = reduce(Column.__or__, [F.col("t").contains(b) for b in BLANKS if b not in " \n"])
    plain = F.lower(F.when(rare, F.regexp_replace("t", r"[\t\x0B\f\r]", " ")).otherwise(F.col("t")))
    return docs.select("k", F.posexplode(F.split(plain, "\n", -1)).alias("pos", "line"))


def classes(docs: DataFrame) -> DataFrame:
    """``h1, h2, k, pos, tokens``: one row per distinct token set with its first occurrence; tokens ascend."""
    hashes = F.transform(F.split("line", " "), lambda w: F.xxhash64(w))
    tokens = F.array_remove(F.array_distinct(F.sort_array(hashes)), F.xxhash64(F.lit("")))  # blanks next to each other
    rows = line_rows(docs).select("k", "pos", tokens.alias("tokens"))
    rows = rows.select(F.xxhash64("tokens").alias("h1"), F.xxhash64(F.lit(1), "tokens").alias("h2"), F.struct("k", "pos").alias("at"), "tokens")
    found = rows.groupBy("h1", "h2").agg(F.min("at").alias("at"), F.first("tokens").alias("tokens"))
    found = found.filter(F.size("tokens") > 0)  # lines without words are one group here
    return found.select("h1", "h2", "at.k", "at.pos", "tokens")


def frequency_bits(n_classes: int) -> int:
    return min(FREQUENCY_BITS, max(10, (n_classes // 2).bit_length()))


def rarity_table(found: DataFrame, size: int) -> Column:
    """Array over ``2**size`` hash buckets, as a scalar subquery: four times the log2 of the classes that have a token there, plus one; in the highest byte."""
    half = size // 2
    bucket = F.shiftrightunsigned("token", 64 - size).cast("int").alias("b")
    tokens = found.select(F.explode("tokens").alias("token")).select(bucket, F.lit(1).alias("one"))
    every = found.sparkSession.range(1 << size).select(F.col("id").cast("int").alias("b"), F.lit(0).alias("one"))
    counts = tokens.union(every).groupBy("b").agg(F.sum("one").alias("n"))
    level = F.when(F.col("n") == 0, 0).otherwise(F.least(F.lit(127), F.floor(4 * F.log2("n")) + 1)).cast("bigint")
    values = lambda pairs: F.transform(F.array_sort(pairs), lambda x: x["r"])
    rows = counts.select(F.shiftright("b", half).alias("high"), "b", F.shiftleft(level, 56).alias("r")).groupBy("high").agg(values(F.collect_list(F.struct("b", "r"))).alias("r"))
    return rows.agg(F.flatten(values(F.collect_list(F.struct("high", "r"))))).scalar()


def prefixes(found: DataFrame, size: int) -> DataFrame:
    """``h1, h2, k, pos, n, bits, prefix``: size, parities of the tokens in 64 slots, and the rarest tokens.

    A key of the prefix is the rarity level above 56 bits of the hash.  The analyser wants no
    subquery in a lambda, so the table is a column first; it is used once, so the optimiser
    puts it in its place and no row ever holds it.
    """
    bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("bigint"), x.bitwiseAND(63).cast("int"))
    bits = F.aggregate("tokens", F.lit(0).cast("bigint"), lambda acc, x: acc.bitwiseXOR(bit(x)))
    key = lambda x: F.get("_rarity", F.shiftrightunsigned(x, 64 - size)) + F.shiftrightunsigned(x, 8)
    n = F.size("tokens")
    prefix = F.slice(F.sort_array(F.transform("tokens", key)), F.lit(1), n - F.ceil(n * NUM / DEN).cast("int") + 1)
    return found.withColumn("_rarity", rarity_table(found, size)).select("h1", "h2", "k", "pos", n.alias("n"), bits.alias("bits"), prefix.alias("prefix"))


#: A class is named by its first occurrence; ``h1, h2`` is its digest.
CLASS = ("k", "pos")


def _may_be(x: dict[str, Column], y: dict[str, Column]) -> Column:
    """Whether two classes that share a token at places ``i`` can be similar, if they share none before.

    In whole numbers and few operations, as it is asked for every meeting in a bucket: with
    ``c`` tokens in common they are similar if ``9 c >= 4 (n + n)``.
    """
    both, total = x["n"] + y["n"], NUM + DEN
    parities = F.bit_count(x["bits"].bitwiseXOR(y["bits"])) * total <= both * (DEN - NUM)
    sizes = (x["n"] * DEN >= y["n"] * NUM) & (y["n"] * DEN >= x["n"] * NUM)
    places = ((x["n"] - x["i"]) * total >= both * NUM) & ((y["n"] - y["i"]) * total >= both * NUM)
    return parities & sizes & places


def hashed(few: DataFrame) -> DataFrame:
    """Few short rows of distinct keys, which a join hashes: then the table of all classes isn't sorted for them."""
    return few.hint("shuffle_hash")


def _pairs(found: DataFrame) -> tuple[DataFrame, str]:
    """Class pairs ``x…`` (later), ``y…`` (earlier), each once, on disk, and where."""
    return written_at(found.distinct(), "line-pairs")


def close_pairs(rows: DataFrame, n_classes: int) -> tuple[DataFrame, str]:
    """First round: a few earlier classes in the buckets of the rarest tokens.

    Only crowded buckets are looked at.  Rows of many buckets are one window's, or the windows
    would be too small to be quick; a bucket of very many rows is dealt over several windows.
    """
    level = F.shiftrightunsigned("token", 56)
    rows = rows.filter(level > 4 * int(log2(CROWDED)))
    salts = F.ceil(F.pow(F.lit(2.0), level / 4) / BUCKET).cast("bigint")  # the level bounds the bucket's classes
    windows = max(1, n_classes * RAREST // BUCKET)
    window = F.pmod(F.xxhash64("token", F.pmod(F.xxhash64(*CLASS), salts)), F.lit(windows))
    order = Window.partitionBy("window").orderBy("token", "k", "pos")
    fields = (*CLASS, "token", "n", "i", "bits")
    before = F.array(*[F.lag(F.struct(*fields), j).over(order) for j in BEFORE])
    met = rows.withColumn("window", window).select(*fields, before.alias("before")).select(*fields, F.explode("before").alias("y"))
    x, y = {c: F.col(c) for c in fields}, {c: F.col(f"y.{c}") for c in fields}
    met = met.filter((x["token"] == y["token"]) & _may_be(x, y))
    return _pairs(met.select(*[x[c].alias(f"x{c}") for c in CLASS], *[y[c].alias(f"y{c}") for c in CLASS]))


def all_pairs(rows: DataFrame) -> tuple[DataFrame, str]:
    """Second round: every class not ``settled`` with every earlier one that it may be similar to."""
    a, b = rows.alias("a"), rows.alias("b")
    x, y = ({c: F.col(f"{side}.{c}") for c in rows.columns} for side in "ab")  # the larger and the smaller
    # Of the smaller's prefix a shorter part will do.  A condition on one side alone would be
    # planned below the shuffle, and the two sides would no longer share one.
    short = y["i"] * (NUM + DEN) <= F.least(x["n"], y["n"]) * (DEN - NUM)
    y_earlier = (y["k"] < x["k"]) | ((y["k"] == x["k"]) & (y["pos"] < x["pos"]))
    once = (y["n"] < x["n"]) | ((y["n"] == x["n"]) & y_earlier)
    unsettled = (y_earlier & ~x["settled"]) | (~y_earlier & ~y["settled"])
    met = a.join(b, (x["token"] == y["token"]) & short & _may_be(x, y) & once & unsettled)
    later = [F.when(y_earlier, x[c]).otherwise(y[c]).alias(f"x{c}") for c in CLASS]
    earlier = [F.when(y_earlier, y[c]).otherwise(x[c]).alias(f"y{c}") for c in CLASS]
    return _pairs(met.select(*later, *earlier))


def verified(found_pairs: tuple[DataFrame, str], found: DataFrame) -> DataFrame:
    """``h1, h2`` of the later classes of the pairs that are similar to the earlier one, each once.

    The pairs and the token sets of their classes are deleted as soon as the answer is written.
    """
    pairs, pairs_path = found_pairs
    ends = pairs.select("xk", "xpos").union(pairs.select("yk", "ypos")).toDF(*CLASS).distinct()
    ends = found.select(*CLASS, "h1", "h2").join(hashed(ends), list(CLASS)).select("h1", "h2")
    sets, sets_path = written_at(found.join(hashed(ends), ["h1", "h2"], "left_semi"), "line-sets")
    x = sets.select(F.col("k").alias("xk"), F.col("pos").alias("xpos"), F.col("tokens").alias("xtokens"), "h1", "h2")
    y = sets.select(F.col("k").alias("yk"), F.col("pos").alias("ypos"), F.col("tokens").alias("ytokens"))
    common = F.size(F.array_intersect("xtokens", "ytokens"))
    enough = common * (NUM + DEN) >= (F.size("xtokens") + F.size("ytokens")) * NUM
    near = pairs.join(x, ["xk", "xpos"]).join(y, ["yk", "ypos"]).filter(enough)
    made = written(near.select("h1", "h2").distinct(), "line-removals")
    for path in (pairs_path, sets_path):
        forgotten(found.sparkSession, path)
    return made


def similar(found: DataFrame) -> DataFrame:
    """``h1, h2`` of classes that are similar to a class with an earlier first occurrence."""
    n_classes = found.count()
    made, made_path = bucketed_at(prefixes(found, frequency_bits(n_classes)), "line-prefixes", ["h1", "h2"])
    met = F.shiftrightunsigned("token", 56) > 1  # a token alone in its hash bucket is of one class
    rows = lambda df, *more: df.select(*CLASS, "n", "bits", F.posexplode("prefix").alias("i", "token"), *more).filter(met)
    settled = verified(close_pairs(rows(made.withColumn("prefix", F.slice("prefix", 1, RAREST))), n_classes), found)
    flagged = made.join(hashed(settled.withColumn("settled", F.lit(True))), ["h1", "h2"], "left").withColumn("settled", F.coalesce("settled", F.lit(False)))
    pairs = all_pairs(rows(flagged, "settled"))
    forgotten(found.sparkSession, made_path)  # before the token sets of the pairs are written
    return settled.unionByName(verified(pairs, found))


def decisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_lines, n_removed, removed`` (line numbers from 0) of every document.

    Lines without words always stay.  A null text has no lines.  Rows with a null id keep
    all lines and are compared with none; rows of one id are one document, and lose the
    same lines.  An empty table gives an empty table.
    """
    docs = pick(docs, k=id_col, t=text_col)
    with_id = docs.dropna()
    found = bucketed(classes(with_id), "line-classes", ["h1", "h2"])
    kept = found.select("h1", "h2", *CLASS).join(hashed(similar(found)), ["h1", "h2"], "left_anti").groupBy("k").agg(F.collect_set("pos").alias("kept"))
    lines = F.coalesce(F.split("t", "\n", -1), F.array().cast("array<string>"))
    worded = F.filter(F.transform(lines, lambda line, i: F.when(has_words(line), i)), lambda i: i.isNotNull())
    numbered = docs.select("k", F.size(lines).alias("n_lines"), worded.alias("worded")).join(kept, "k", "left")
    none = F.array().cast("array<int>")
    removed = F.when(F.col("k").isNull(), none).otherwise(F.array_except("worded", F.coalesce("kept", none)))
    out = numbered.select(F.col("k").alias("doc_id"), "n_lines", F.array_sort(removed).alias("removed"))
    return out.select("doc_id", "n_lines", F.size("removed").alias("n_removed"), "removed")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the removed lines taken out of ``text_col``; other columns as they are."""
    made = decisions(docs, id_col, text_col).filter("n_removed > 0").dropDuplicates(["doc_id"]).select(F.col("doc_id").alias("_k"), F.col("removed").alias("_removed"))
    plain, (k, t) = numbered(docs, id_col, text_col)
    joined = plain.join(made, k == F.col("_k"), "left")
    left = F.array_join(F.filter(F.split(t, "\n", -1), lambda _, i: ~F.array_contains(F.col("_removed"), i)), "\n")
    changed = F.when(F.col("_k").isNull(), t).otherwise(left)
    at = docs.columns.index(text_col)
    return joined.select(*[changed.alias(c) if i == at else F.col(c) for i, c in enumerate(plain.columns)]).toDF(*docs.columns)


#: The same decisions for DuckDB.
SQL = r"""
WITH l AS (
  SELECT doc_id, n_lines, pos, list_distinct(list_filter(regexp_split_to_array(lower(line), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS toks
  FROM (SELECT doc_id, len(string_split(text, chr(10))) AS n_lines, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents)
), s AS (
  SELECT list_sort(toks) AS toks, len(toks) AS n, min({'d': doc_id, 'p': pos}) AS o FROM l WHERE len(toks) > 0 GROUP BY ALL
), e AS (SELECT o, n, unnest(toks) AS tok FROM s),
c AS (SELECT tok, count(*) AS f FROM e GROUP BY tok),
r AS (SELECT e.o, e.n, e.tok, row_number() OVER (PARTITION BY e.o ORDER BY c.f, e.tok) AS i FROM e JOIN c USING (tok)),
p AS (SELECT * FROM r WHERE i <= n - CAST(ceil(n * 4 / 5) AS BIGINT) + 1),
pairs AS (SELECT DISTINCT x.o AS later, y.o AS earlier FROM p x JOIN p y ON x.tok = y.tok AND y.o < x.o AND 5 * least(x.n, y.n) >= 4 * greatest(x.n, y.n)),
bad AS (
  SELECT DISTINCT later AS o FROM pairs JOIN s a ON a.o = later JOIN s b ON b.o = earlier
  WHERE 9 * len(list_intersect(a.toks, b.toks)) >= 4 * (a.n + b.n)
), kept AS (SELECT o FROM s ANTI JOIN bad USING (o)),
m AS (
  SELECT l.doc_id, any_value(l.n_lines) AS n_lines, list(l.pos ORDER BY l.pos) FILTER (WHERE len(l.toks) > 0 AND kept.o IS NULL) AS removed
  FROM l LEFT JOIN kept ON kept.o = {'d': l.doc_id, 'p': l.pos} GROUP BY l.doc_id
)
SELECT doc_id, CAST(n_lines AS INTEGER) AS n_lines, CAST(coalesce(len(removed), 0) AS INTEGER) AS n_removed,
  coalesce(array_to_string(removed, ','), '') AS removed
FROM m
"""
