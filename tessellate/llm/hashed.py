"""Hashed text features, and bounded samples of labelled texts."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pick

#: Tokens that a worker remembers; beyond it the memory starts anew.
REMEMBERED = 150_000
EDGES = ".,;:!?\"'()[]{}<>«»„“”‘’…*_`~|#&%$"
#: Odd multipliers that mix hashes of neighbours.
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


class Remembered(dict):
    """What ``made`` gives for a token, kept for later."""

    def __init__(self, made):
        super().__init__()
        self.made = made

    def __missing__(self, token):
        self[token] = value = self.made(token)
        return value

    def of(self, tokens: list[str], kind) -> np.ndarray:
        if len(self) > REMEMBERED:
            self.clear()
        return np.fromiter(map(self.__getitem__, tokens), kind, len(tokens))


def word_hash(token: str) -> int:
    """Of the token in lower case without punctuation at its ends (or whole, if nothing is left)."""
    return xxhash.xxh64_intdigest((token.strip(EDGES) or token).lower().encode(), 7)


def stem_hashes(token: str) -> tuple[int, ...]:
    """Of the first four and five letters of a longer word."""
    word = (token.strip(EDGES) or token).lower()
    return tuple(xxhash.xxh64_intdigest(word[:n].encode(), n) for n in (4, 5) if len(word) > n)


def buckets(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The upper bits of mixed hashes."""
    return ((hashes * MIX[0]) >> np.uint64(64 - bits)).astype(np.int64)


class Grams:
    """Distinct buckets of a text's words, their stems, n-grams and skip-grams."""

    def __init__(self, bits: int, grams: int = 2, skips: int = 1):
        self.bits, self.grams, self.skips = bits, grams, skips
        self.words, self.stems = Remembered(word_hash), Remembered(stem_hashes)

    def of(self, text: str) -> np.ndarray:
        tokens = text.split()
        stems = {h for t in set(tokens) for h in self.stems[t]}
        if len(self.stems) > REMEMBERED:
            self.stems.clear()
        stems = np.fromiter(stems, np.uint64, len(stems))
        return gram_buckets(self.words.of(tokens, np.uint64), self.bits, self.grams, self.skips, stems)


def gram_buckets(words: np.ndarray, bits: int, grams: int, skips: int, more: np.ndarray) -> np.ndarray:
    """Distinct buckets of the word n-grams up to ``grams``, the skip-grams over up to ``skips`` words, and ``more`` hashes."""
    parts, run = [words, more], words
    with np.errstate(over="ignore"):
        for n in range(1, grams):
            run = run[:-1] * MIX[1] + words[n:]
            parts.append(run + np.uint64(n))
        for gap in range(2, skips + 2):
            if len(words) > gap:
                parts.append(words[:-gap] * MIX[2] + words[gap:] + np.uint64(100 + gap))
        return np.unique(buckets(np.concatenate(parts), bits))


def labelled(docs: DataFrame, labels: DataFrame, label_col: str, taken: Column | None, most: int) -> tuple[list[tuple[int, str]], dict[int, int]]:
    """(label, text) of a sample of labelled documents, and how many documents each label has.

    At most about ``most`` documents of each label, chosen by a hash of the id, come to the
    driver; ``taken`` restricts the ids (column ``k``) that may be learned from.  Rows with
    a null id, label or text are left out; of several labels of a document the highest
    counts, and repeated documents count once.
    """
    rated = pick(labels, k="doc_id", y=label_col).dropna().filter(taken if taken is not None else F.lit(True)).groupBy("k").agg(F.max("y").cast("int").alias("y"))
    counts = {int(y): int(n) for y, n in rated.groupBy("y").agg(F.count("*")).collect()}
    share = F.lit(0.0)
    for y, n in counts.items():
        share = F.when(F.col("y") == y, F.lit(min(1.0, most / n))).otherwise(share)
    chosen = rated.filter(F.pmod(F.xxhash64("k", F.lit("sample")), F.lit(1 << 30)) < share * (1 << 30))
    texts = pick(docs, k="doc_id", t="text").dropna().join(F.broadcast(chosen), "k").groupBy("k").agg(F.max(F.struct("y", "t")).alias("x"))
    return sorted((int(r[0]), r[1]) for r in texts.select("x.y", "x.t").collect()), counts
