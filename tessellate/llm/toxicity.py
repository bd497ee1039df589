"""Toxicity scores by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

The model is fitted on the driver, on a bounded sample of labelled documents.  Every
coordinate has its own learning rate, and the L1 term leaves most weights at exactly
zero, so what is broadcast is a short list of buckets and weights whatever the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, pick
from .hashed import Grams, labelled

FOLDS, TEST_FOLD = 5, 0


@dataclass
class FTRL:
    """FTRL-proximal logistic regression on sets of hashed features."""

    bits: int = 20
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 4.0
    l2: float = 0.1
    bias: float = 0.0
    z: np.ndarray = field(init=False, repr=False)
    n: np.ndarray = field(init=False, repr=False)

    def __post_init__(self):
        self.z, self.n = np.zeros((1 << self.bits) + 1), np.zeros((1 << self.bits) + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        l1 = np.where(at == 1 << self.bits, 0.0, self.l1)  # the last coordinate is the intercept
        return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, label: int) -> None:
        at = np.append(at, 1 << self.bits).astype(np.int64)
        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35)))
        g = p - label
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] += g * g

    def sparse(self) -> tuple[np.ndarray, np.ndarray, float]:
        w = self.weights(np.arange((1 << self.bits) + 1))
        at = np.flatnonzero(w[:-1])
        return at, w[:-1][at], float(w[-1])


def fit(rows: list[tuple[int, str]], counts: dict[int, int], bits: int = 20, epochs: int = 4) -> dict:
    """Sparse weights from (label, text) rows; the intercept is set to the labels' share in ``counts``.

    Without rows of both labels every score is the share of label 1 (0.5 without any).
    """
    positives = sum(y for y, _ in rows)
    have, all_ = positives, sum(counts.values())
    share = min(max(counts.get(1, 0) / all_ if all_ else 0.5, 1e-6), 1 - 1e-6)
    if not 0 < positives < len(rows):
        return {"bits": bits, "at": np.empty(0, np.int64), "w": np.empty(0), "bias": float(np.log(share / (1 - share)))}
    features, model = Grams(bits), FTRL(bits)
    data = [(features.of(t).astype(np.int32), y) for y, t in rows]
    rng = np.random.default_rng(17)
    for _ in range(epochs):
        for k in rng.permutation(len(data)).tolist():
            model.learn(*data[k])
    at, w, bias = model.sparse()
    odds = np.log(share / (1 - share)) - np.log(have / (len(rows) - have))
    return {"bits": bits, "at": at, "w": w, "bias": bias + float(odds)}


def scores(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score`` of every whole text; null and empty texts get the intercept's score."""
    kind = docs.schema.fields[docs.columns.index(id_col)].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        features = Grams(m["bits"])
        weight = np.zeros(1 << m["bits"])
        weight[m["at"]] = m["w"]
        for batch in batches:
            logits = [weight[features.of(t.as_py() or "")].sum() for t in batch.column("t")]
            p = 1 / (1 + np.exp(-np.clip(np.array(logits, float) + m["bias"], -35, 35)))
            yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array(p)], ["doc_id", "score"])

    return pick(docs, k=id_col, t=text_col).mapInArrow(run, f"doc_id {kind}, score double")


def toxic(docs: DataFrame, labels: DataFrame, most: int = 3000) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every document.

    Learned from at most about ``most`` documents of each label outside the held-out fold.
    Null ids are never held out nor learned from; repeated rows stay; an empty table gives
    an empty table.
    """
    rows, counts = labelled(docs, labels, "toxic", ~held_out(F.col("k"), FOLDS, TEST_FOLD), most)
    out = scores(docs, fit(rows, counts))
    return out.select("doc_id", held_out(F.col("doc_id"), FOLDS, TEST_FOLD).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
