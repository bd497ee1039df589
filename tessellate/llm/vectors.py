"""Vector codes: codebooks learned by Yinyang Lloyd, in whole numbers.

A codebook's entries are put into groups once.  Every vector part keeps, besides its
entry, one lower bound of its distance to each group's other entries.  When entries have
moved, a group's bound shrinks by the farthest move in it; only groups whose bound no
longer exceeds the distance to the part's own entry are scanned.  Distances are first
estimated by a matrix product; what may be nearest is measured in whole numbers, so ties
are exact and go to the lower index.

Vectors are never shuffled.  A round is one pass over the table of vectors with their
bounds, which is written with the sums that the next codebooks need; only codebooks and
those sums (a row for each entry) come to the driver.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forgotten, pick, shared_dir, written

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Entries of a group, about.
GROUP = 10
#: Whole components lie below this, so that squared distances of up to 1024 components fit 64 bits.
MOST = 1 << 25
SLICE = 2048
#: Relative error that estimates of distances may have.
SLACK = 2.0**-40


def integral(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS) -> DataFrame:
    """``k, label, v``: vectors as whole numbers floor(1024 x), without those that are null or hold null or non-finite components.

    All have the size of the first kept one (by id); others, and those that can't be cut
    into equal parts, are left out.  A component of 2^25 or more in whole numbers raises.
    """
    rows = pick(vectors, k=id_col, label=label_col, v=vector_col)
    x = lambda v: v.cast("double")
    finite = F.forall("v", lambda v: F.coalesce(~F.isnan(x(v)) & (F.abs(x(v)) != float("inf")), F.lit(False)))
    whole = lambda v: F.when(F.abs(x(v)) * SCALE < MOST, F.floor(x(v) * SCALE)).otherwise(F.raise_error(F.lit("a component is too large")).cast("bigint"))
    rows = rows.filter(F.col("v").isNotNull() & finite & (F.size("v") > 0) & (F.size("v") % parts == 0))
    return rows.select("k", "label", F.transform("v", whole).alias("v"))


def grouped_entries(codebook: np.ndarray, group: int = GROUP) -> np.ndarray:
    """A group for each entry, by a few rounds of k-means over the entries."""
    n = -(-len(codebook) // group)
    points = codebook.astype(np.float64)
    centres = points[np.arange(n) * len(points) // n]
    for _ in range(5):
        of = ((points[:, None] - centres[None]) ** 2).sum(2).argmin(1)
        for g in range(n):
            if (of == g).any():
                centres[g] = points[of == g].mean(0)
    return of


def _exact(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((x - c) ** 2).sum(1)


def _scan(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row of ``x``: the nearest entry (the lowest of several), its squared distance, and a lower bound of the others'."""
    xf, cf = x.astype(np.float64), entries.astype(np.float64)
    xx, cc = (xf**2).sum(1)[:, None], (cf**2).sum(1)[None]
    about = xx - 2 * xf @ cf.T + cc
    slack = (xx[:, 0] + cc.max()) * SLACK
    rows, cols = np.nonzero(about <= about.min(1)[:, None] + 2 * slack[:, None])
    exact = np.full(about.shape, np.iinfo(np.int64).max)
    exact[rows, cols] = _exact(x[rows], entries[cols])
    best = exact.argmin(1)
    every = np.arange(len(x))
    distance = exact[every, best]
    about[every, best] = np.inf
    return best, distance, np.maximum(about.min(1) - slack, 0)


def _packed(bounds: np.ndarray) -> np.ndarray:
    """Upper halves of 32-bit floats: never above the bound."""
    return (np.nextafter(bounds.astype(np.float32), np.float32(0)).view(np.uint32) >> 16).astype(np.uint16)


def _unpacked(bounds: np.ndarray) -> np.ndarray:
    return (bounds.astype(np.uint32) << 16).view(np.float32).astype(np.float64)


def assigned(x: np.ndarray, codebook: np.ndarray, groups: np.ndarray, code: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """``code, distance, bounds`` after a codebook's move, and how many distances were estimated.

    ``bounds`` (a column a group) are lower bounds of the distance to all entries of the
    group but the row's own ``code``, drift already taken off.
    """
    distance, bounds = _exact(x, codebook[code]), bounds.copy()
    members = [np.flatnonzero(groups == g) for g in range(bounds.shape[1])]
    failed = bounds**2 * (1 - 1e-9) <= distance[:, None]
    new, least, looked = code.copy(), distance.copy(), 0
    firsts, nexts = np.full(bounds.shape, -1), np.zeros(bounds.shape)
    near = np.zeros(bounds.shape)
    for g, own in enumerate(members):
        rows = np.flatnonzero(failed[:, g])
        if not len(rows) or not len(own):
            continue
        looked += len(rows) * len(own)
        best, d, second = _scan(x[rows], codebook[own])
        firsts[rows, g], near[rows, g], nexts[rows, g] = own[best], np.sqrt(d), np.sqrt(second)
        better = (d < least[rows]) | ((d == least[rows]) & (own[best] < new[rows]))
        new[rows[better]], least[rows[better]] = own[best[better]], d[better]
    scanned = firsts >= 0
    bounds = np.where(scanned, np.where(firsts == new[:, None], nexts, near), bounds)
    left = np.flatnonzero(new != code)  # the entry that a row has left counts among its group's others
    g = groups[code[left]]
    bounds[left, g] = np.minimum(bounds[left, g], np.where(scanned[left, g], np.inf, np.sqrt(distance[left])))
    return new, least, bounds, looked


def _round(state: DataFrame, books: list[np.ndarray], groups: list[np.ndarray], drifts: list[np.ndarray] | None) -> DataFrame:
    """A pass over ``state (k, label, v, code, bounds)``: assigned anew, with rows of sums by part and entry at each task's end."""
    kind, parts = state.schema["k"].dataType.simpleString(), len(books)
    label = state.schema["label"].dataType.simpleString()
    schema = f"k {kind}, label {label}, v array<bigint>, code binary, bounds binary, error bigint, part int, entry int, sums array<bigint>, n bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros(b.shape, np.int64) for b in books]
        counts = [np.zeros(len(b), np.int64) for b in books]
        fields = None
        for batch in batches:
            fields = batch.schema
            for at in range(0, len(batch), SLICE):
                part = batch.slice(at, SLICE)
                n, width = len(part), sum(b.shape[1] for b in books)
                v = part.column("v").flatten().to_numpy().reshape(n, width)
                codes = np.zeros((n, parts), np.uint8)
                if drifts is not None:
                    codes = np.frombuffer(b"".join(part.column("code").to_pylist()), np.uint8).reshape(n, parts)
                    held = np.frombuffer(b"".join(part.column("bounds").to_pylist()), np.uint16).reshape(n, -1)
                made, kept, error, column, at_bound = np.zeros((n, parts), np.uint8), [], np.zeros(n, np.int64), 0, 0
                for j, (book, of) in enumerate(zip(books, groups, strict=True)):
                    x, t = v[:, column : column + book.shape[1]], int(of.max()) + 1
                    column += book.shape[1]
                    bounds = np.zeros((n, t))
                    if drifts is not None:
                        bounds = np.maximum(_unpacked(held[:, at_bound : at_bound + t]) - drifts[j], 0)
                    at_bound += t
                    code, distance, bounds, _ = assigned(x, book, of, codes[:, j].astype(np.int64), bounds)
                    made[:, j] = code
                    kept.append(_packed(np.minimum(bounds, 3e38)))
                    error += distance
                    np.add.at(sums[j], code, x)
                    counts[j] += np.bincount(code, minlength=len(book))
                packed = np.concatenate(kept, axis=1)
                columns = [part.column("k"), part.column("label"), part.column("v"), pa.array([c.tobytes() for c in made], pa.binary()), pa.array([b.tobytes() for b in packed], pa.binary()), pa.array(error)]
                empty = [pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns + empty, names)
        if fields is None:
            return
        for j, (s, c) in enumerate(zip(sums, counts, strict=True)):
            used = np.flatnonzero(c)
            nothing = [pa.nulls(len(used), fields.field("k").type), pa.nulls(len(used), fields.field("label").type), pa.nulls(len(used), pa.list_(pa.int64())), pa.nulls(len(used), pa.binary()), pa.nulls(len(used), pa.binary()), pa.nulls(len(used), pa.int64())]
            filled = [pa.array(np.full(len(used), j, np.int32)), pa.array(used.astype(np.int32)), pa.array(list(s[used]), pa.list_(pa.int64())), pa.array(c[used])]
            yield pa.RecordBatch.from_arrays(nothing + filled, names)

    names = ["k", "label", "v", "code", "bounds", "error", "part", "entry", "sums", "n"]
    return state.mapInArrow(run, schema)


def _moved(made: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """The codebooks after a pass: each entry the componentwise floor of its parts' mean; unused ones stay."""
    width = max(b.shape[1] for b in books)
    sums = made.filter("part IS NOT NULL").groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(width)])
    moved = [b.copy() for b in books]
    for row in sums.collect():
        moved[row["part"]][row["entry"]] = [row[f"s{i}"] // row["n"] for i in range(books[row["part"]].shape[1])]
    return moved


def trained(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """``k, label, code, error`` of ``rows (k, label, v)`` by codebooks of ``rounds`` rounds, on disk, and the codebooks.

    A codebook starts with that part of the first rows by id (null ids last, rows of one id
    by vector).  No rows give no codebooks.
    """
    spark = rows.sparkSession
    first = rows.orderBy(F.col("k").asc_nulls_last(), "v").limit(entries).collect()
    if not first:
        return rows.select("k", "label", F.lit(b"").alias("code"), F.lit(0).cast("bigint").alias("error")), []
    size = len(first[0]["v"])
    same = [r["v"] for r in first if len(r["v"]) == size]
    rows = rows.filter(F.size("v") == size)
    if len(same) < len(first):  # sizes differ: the first rows of the right size
        same = [r["v"] for r in rows.orderBy(F.col("k").asc_nulls_last(), "v").limit(entries).collect()]
    books = np.split(np.array(same, np.int64), parts, axis=1)
    groups = [grouped_entries(b) for b in books]
    state, drifts, folder = rows, None, ""
    for _ in range(rounds):
        path = f"{shared_dir(spark)}/tessellate-codes-{uuid.uuid4().hex}"
        made = _round(state, books, groups, drifts)
        made.write.parquet(path)
        made = spark.read.schema(made.schema).parquet(path)
        moved = _moved(made, books)
        drifts = []
        for old, new, of in zip(books, moved, groups, strict=True):
            move = np.sqrt(((new - old) ** 2).sum(1)) * (1 + 1e-9)
            drifts.append(np.array([move[of == g].max(initial=0.0) for g in range(int(of.max()) + 1)]))
        books, state = moved, made.filter("part IS NULL").select("k", "label", "v", "code", "bounds")
        if folder:
            forgotten(spark, folder)
        folder = path
    last = _round(state, books, groups, drifts).filter("part IS NULL").select("k", "label", "code", "error")
    last = written(last, "codes")
    if folder:
        forgotten(spark, folder)
    return last, books


def coded(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """Code and error of every vector, its label's summed error, and a digest of the codebooks.

    Vectors that are null, or hold null or non-finite components, are left out
    (:func:`integral`); rows with a null id stay, repeated rows too; null labels are one
    label.  An empty table gives an empty table.
    """
    rows, books = trained(integral(vectors, id_col, vector_col, label_col, parts), parts, entries, rounds)
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b.tolist() for x in e).encode()).hexdigest()
    labels = rows.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    found = rows.join(labels, F.col("label").eqNullSafe(F.col("_label")))
    return found.select(F.col("k").alias(id_col), F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


_PART = "SELECT vec_id, p, v[p * len(v) // 4 + 1:(p + 1) * len(v) // 4] AS x FROM kept, (SELECT unnest(range(4)) AS p)"
_NEAREST = "min(list_sum(list_transform(list_zip(x, c), lambda t: (t[1] - t[2]) * (t[1] - t[2])))::BIGINT * 256 + e)"


def _sql() -> str:
    """The same in SQL: each round assigns all parts and moves the codebooks."""
    text = f"""WITH kept AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), parts AS MATERIALIZED ({_PART}), c0 AS MATERIALIZED (SELECT * FROM (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS c FROM parts) WHERE e < {ENTRIES})"""
    for k in range(ROUNDS):
        text += f""", a{k} AS MATERIALIZED (SELECT vec_id, p, any_value(x) AS x, {_NEAREST} % 256 AS e FROM parts JOIN c{k} USING (p) GROUP BY vec_id, p),
m{k} AS (SELECT p, e, list(m ORDER BY i) AS m FROM (SELECT p, e, i, CAST(floor(sum(y) / count(*)) AS BIGINT) AS m FROM (SELECT p, e, unnest(x) AS y, unnest(range(len(x))) AS i FROM a{k}) GROUP BY p, e, i) GROUP BY p, e),
c{k + 1} AS MATERIALIZED (SELECT c{k}.p, c{k}.e, coalesce(m, c) AS c FROM c{k} LEFT JOIN m{k} ON m{k}.p = c{k}.p AND m{k}.e = c{k}.e)"""
    last = f"c{ROUNDS}"
    return text + f""", f AS (SELECT vec_id, p, {_NEAREST} AS d FROM parts JOIN {last} USING (p) GROUP BY vec_id, p),
r AS (SELECT vec_id, string_agg(printf('%02x', d % 256), '' ORDER BY p) AS code, CAST(sum(d // 256) AS BIGINT) AS error FROM f GROUP BY vec_id),
s AS (SELECT sha256(string_agg(y, ',' ORDER BY p, e, i)) AS digest FROM (SELECT p, e, unnest(c) AS y, unnest(range(len(c))) AS i FROM {last}))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, digest AS codebooks_sha256 FROM r JOIN kept USING (vec_id), s"""


SQL = _sql()
