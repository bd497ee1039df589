"""Quality grades by ordinal cumulative-link regression over hashed text.

``P(grade > k) = 1 / (1 + exp(-(w·x - t_k)))`` with one weight vector ``w`` for all grades
and ascending thresholds ``t``; ``x`` holds hashed words, hashed token shapes and hashed
levels of repetition.  The expected grade is the lowest grade plus the tail probabilities.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import masked, pick
from .hashed import MIX, Remembered, buckets, labelled, word_hash

BITS = 16
RUNS = re.compile(r"(.)\1+")
LETTERS = str.maketrans({**{chr(c): "a" for c in range(97, 123)}, **{chr(c): "A" for c in range(65, 91)}, **{str(d): "0" for d in range(10)}})


def shape_hash(token: str) -> int:
    """Of the token with letters and digits replaced by their kind, runs shortened to one."""
    kinds = token.translate(LETTERS)
    if not kinds.isascii():
        kinds = "".join("a" if c.islower() else "A" if c.isupper() else c for c in kinds)
    return xxhash.xxh64_intdigest(RUNS.sub(r"\1", kinds).encode(), 11)


class Features:
    """(buckets, values) of a text: two unit vectors (words, shapes) and its levels of repetition and length."""

    def __init__(self):
        self.words, self.shapes = Remembered(word_hash), Remembered(shape_hash)

    def of(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        tokens = text.split()
        if not tokens:
            return np.array([0]), np.ones(1)
        words = self.words.of(tokens, np.uint64)
        parts = []
        for hashes in (words, self.shapes.of(tokens, np.uint64)):
            at, n = np.unique(buckets(hashes, BITS), return_counts=True)
            parts.append((at, n / np.sqrt((n * n).sum())))
        with np.errstate(over="ignore"):
            pairs = words[:-1] * MIX[1] + words[1:]
        repeated = 1 - len(np.unique(pairs)) / len(pairs) if len(pairs) else 0.0
        distinct = len(np.unique(words)) / len(words)
        levels = [f"pairs {int(repeated * 10)}", f"words {int(distinct * 10)}", f"length {len(tokens).bit_length()}", f"pairs in length {int(repeated * 5)} {len(tokens).bit_length() // 2}"]
        parts.append((buckets(np.array([xxhash.xxh64_intdigest(x.encode(), 13) for x in levels], np.uint64), BITS), np.full(len(levels), 0.5)))
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def slopes(score: float, t: np.ndarray, y: int) -> tuple[float, np.ndarray]:
    """Derivatives of a row's negative log-likelihood by its score and by the thresholds."""
    above = 1 / (1 + np.exp(np.clip(t - score, -35, 35)))  # P(grade > k)
    p, slope = np.r_[1.0, above, 0.0], np.r_[0.0, above * (1 - above), 0.0]
    likely = max(p[y] - p[y + 1], 1e-9)
    by_t = np.zeros(len(t))
    if y > 0:
        by_t[y - 1] = slope[y] / likely
    if y < len(t):
        by_t[y] = -slope[y + 1] / likely
    return -(slope[y] - slope[y + 1]) / likely, by_t


def fit(rows: list[tuple[int, str]], counts: dict[int, int], epochs: int = 12, rate: float = 0.3, l2: float = 1e-6) -> dict:
    """Weights and thresholds from (grade, text) rows, each grade weighted to its share in ``counts``.

    Thresholds are the first one plus squares, so they ascend.  Fewer than two grades give
    a constant model: that grade (or 0) with certainty.
    """
    grades = sorted({y for y, _ in rows})
    if len(grades) < 2:
        return {"grades": grades or [0], "w": np.zeros(1 << BITS), "t": np.empty(0)}
    features, place = Features(), {g: k for k, g in enumerate(grades)}
    data = [(at.astype(np.int32), x.astype(np.float32), place[y]) for y, t in rows for at, x in [features.of(t)]]
    have = np.bincount([y for _, _, y in data])
    share = np.array([counts[g] for g in grades]) / sum(counts[g] for g in grades)
    importance = share / (have / have.sum())
    w, gw = np.zeros(1 << BITS), np.full(1 << BITS, 1e-8)
    steps = np.r_[-1.0, np.ones(len(grades) - 2)]  # the first threshold, then roots of the distances
    gs = np.full(len(steps), 1e-8)
    rng = np.random.default_rng(23)
    for epoch in range(epochs):
        for k in rng.permutation(len(data)).tolist():
            at, x, y = data[k]
            t = np.cumsum(np.r_[steps[0], steps[1:] ** 2])
            d_score, d_t = (d * importance[y] for d in slopes(w[at] @ x, t, y))
            g = d_score * x + l2 * w[at]
            np.add.at(gw, at, g * g)
            np.subtract.at(w, at, rate * g / np.sqrt(gw[at]) / (1 + epoch / 4))
            back = np.cumsum(d_t[::-1])[::-1]
            g = back * np.r_[1.0, 2 * steps[1:]]
            gs += g * g
            steps -= rate * g / np.sqrt(gs) / (1 + epoch / 4)
    return {"grades": grades, "w": w, "t": np.cumsum(np.r_[steps[0], steps[1:] ** 2])}


def tails(model: dict, at: np.ndarray, x: np.ndarray) -> np.ndarray:
    """P(grade > k) for each grade but the highest."""
    return 1 / (1 + np.exp(np.clip(model["t"] - model["w"][at] @ x, -35, 35)))


def graded(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, expected_grade, tail_probability`` of every whole text; a null text counts as empty.

    ``tail_probability`` is that of the highest grade.
    """
    kind = docs.schema.fields[docs.columns.index(id_col)].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, features = sent.value, Features()
        gaps = np.diff(m["grades"])
        for batch in batches:
            found = [tails(m, *features.of(t.as_py() or "")) for t in batch.column("t")]
            grade = [float(m["grades"][0] + gaps @ p) for p in found]
            tail = [float(p[-1]) if len(p) else 1.0 for p in found]
            yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array(grade, pa.float64()), pa.array(tail, pa.float64())], ["doc_id", "expected_grade", "tail_probability"])

    return pick(docs, k=id_col, t=text_col).mapInArrow(run, f"doc_id {kind}, expected_grade double, tail_probability double")


def model_of(docs: DataFrame, labels: DataFrame, most: int = 2000, taken: Column | None = None) -> dict:
    """Fitted on at most about ``most`` documents of each grade, of those whose id (column ``k``) is ``taken``."""
    return fit(*labelled(docs, labels, "quality", taken, most))


def selected(docs: DataFrame, labels: DataFrame, least: float = 0.5, most: int = 2000) -> DataFrame:
    """``doc_id, expected_grade, tail_probability, keep`` for every document.

    ``keep`` is true where the tail probability is at least ``least``.  Repeated rows and
    null ids stay; an empty table gives an empty table.
    """
    return graded(docs, model_of(docs, labels, most)).withColumn("keep", F.col("tail_probability") >= least)


def of_quality(docs: DataFrame, labels: DataFrame, least: float = 0.5, most: int = 2000, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose tail probability is at least ``least``.

    A null text counts as empty and is judged like any other; rows with a null id and
    repeated rows are judged by their text too; without labels of two grades all stay.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model_of(docs, labels, most))

    def decider():
        features, m = Features(), sent.value

        def decide(texts: list[str]) -> list[bool]:
            return [not len(m["t"]) or bool(tails(m, *features.of(t))[-1] >= least) for t in texts]

        return decide

    return masked(docs, text_col, decider)
