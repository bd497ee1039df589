"""Language identification of mixed texts: script ranges, word scores and Viterbi spans.

Words are cut where the script changes and after every 64 letters, so that text without
spaces is read to its end; each piece is a word of its own.  A word's script narrows the
languages it can be of to those seen in that script; letters of other scripts count for no
language.  Each word gets a log-posterior over the languages from hashed character n-grams.  Viterbi with
a penalty for every switch then labels spans.  Words of a whole batch are scanned at once:
texts are cut into blocks of equal length, every block is solved from each start language
side by side (a max-plus matrix a block), and the blocks of a text are chained.
"""

from __future__ import annotations

import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessellate.operators.documents import slices

from .common import held_out, masked, pick
from .hashed import MIX, REMEMBERED, buckets

FOLDS, TEST_FOLD = 4, 2
BITS, GRAMS = 16, 4
PENALTY = 6.0
#: Words of a block, times languages.
BLOCK = 16
#: Letters that are scored together at most; longer words are several.
PIECE = 64
#: Log-posteriors are cut here, so that no single word decides.
FLOOR = -5.0
#: First and last code point of ranges of letters, by script (fixed values).
SCRIPTS = {
    "Latin": [(0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0x24F), (0x250, 0x2AF), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFF21, 0xFF3A), (0xFF41, 0xFF5A)],
    "Greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "Cyrillic": [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)],
    "Armenian": [(0x530, 0x58F)],
    "Hebrew": [(0x590, 0x5FF)],
    "Arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)],
    "Devanagari": [(0x900, 0x97F)],
    "Bengali": [(0x980, 0x9FF)],
    "Tamil": [(0xB80, 0xBFF)],
    "Telugu": [(0xC00, 0xC7F)],
    "Thai": [(0xE00, 0xE7F)],
    "Georgian": [(0x10A0, 0x10FF), (0x1C90, 0x1CBF)],
    "Hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)],
    "Kana": [(0x3040, 0x30FF), (0x31F0, 0x31FF)],
    "Han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x2FA1F)],
}
_RANGES = sorted((a, b, name) for name, ranges in SCRIPTS.items() for a, b in ranges)
_STARTS = np.array([a for a, _, _ in _RANGES])


@lru_cache(100_000)
def script_of(char: str) -> str:
    """Name of the script of a letter (``other`` outside the ranges)."""
    c = ord(char)
    k = int(np.searchsorted(_STARTS, c, "right")) - 1
    return _RANGES[k][2] if k >= 0 and c <= _RANGES[k][1] else "other"


def letters_of(token: str) -> str:
    """The token's letters, composed and in lower case."""
    if not token.isascii():
        token = unicodedata.normalize("NFC", token)
    return (token if token.isalpha() else "".join(filter(str.isalpha, token))).lower()


def pieces_of(token: str) -> list[str]:
    """The token's letters, cut where the script changes and after every ``PIECE`` letters; one empty piece if there are none."""
    word = letters_of(token)
    if len(word) <= PIECE and word.isascii():
        return [word]
    runs = ["".join(run) for _, run in groupby(word, script_of)]
    return [run[at : at + PIECE] for run in runs for at in range(0, len(run), PIECE)] or [""]


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words and of their character n-grams (ends marked), and the words' numbers."""
    marked = [f"^{w}$" for w in words]
    sizes = np.fromiter(map(len, marked), np.int64, len(marked))
    chars = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), sizes)
    whole = np.fromiter((xxhash.xxh64_intdigest(w.encode(), 5) for w in words), np.uint64, len(words))
    hashes, owners, run = [whole, chars + np.uint64(1)], [np.arange(len(words)), owner], chars
    with np.errstate(over="ignore"):
        for n in range(2, GRAMS + 1):
            run = run[:-1] * MIX[1] + chars[n - 1 :]
            same = owner[: len(run)] == owner[n - 1 :]
            hashes.append(run[same] * MIX[2] + np.uint64(n))
            owners.append(owner[: len(run)][same])
        return buckets(np.concatenate(hashes), BITS), np.concatenate(owners)


class Model:
    """Languages, scripts of each, and the log-probability of every n-gram bucket in each."""

    def __init__(self, langs: list[str], scripts: dict[str, np.ndarray], logs: np.ndarray):
        self.langs, self.scripts, self.logs = langs, scripts, logs

    def scores(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each piece: log-posteriors over the languages (best: 0), letters, and whether these are of a script never learned."""
        letters = np.fromiter(map(len, words), np.int64, len(words))
        found = np.zeros((len(words), len(self.langs)))
        known = [k for k, w in enumerate(words) if w and script_of(w[0]) in self.scripts]
        if known:
            at, owner = grams([words[k] for k in known])
            n = np.bincount(owner, minlength=len(known))
            weight = np.minimum(letters[known] + 1, 6) / n
            allowed = np.array([self.scripts[script_of(words[k][0])] for k in known])
            for l in range(len(self.langs)):
                mean = np.bincount(owner, weights=self.logs[l][at], minlength=len(known)) * weight
                found[known, l] = np.where(allowed[:, l], mean, -np.inf)
            found -= found.max(axis=1, keepdims=True)
        strange = letters > 0
        strange[known] = False
        return np.maximum(found, FLOOR).astype(np.float32), letters, strange


def fit(rows: list[tuple[str, str]]) -> Model:
    """From (language, text) rows; every language has the same weight."""
    words: dict[str, Counter] = defaultdict(Counter)
    for lang, text in rows:
        words[lang].update(text.split())
    langs = sorted(words)
    counts, seen = np.zeros((len(langs), 1 << BITS)), defaultdict(lambda: np.zeros(len(langs)))
    for k, lang in enumerate(langs):
        items = [(w, n) for t, n in words[lang].items() for w in pieces_of(t) if w]
        for first in range(0, len(items), 10_000):
            part = items[first : first + 10_000]
            at, owner = grams([w for w, _ in part])
            counts[k] += np.bincount(at, weights=np.array([n for _, n in part], float)[owner], minlength=1 << BITS)
        for w, n in items:
            seen[script_of(w[0])][k] += len(w) * n
    total = sum(seen.values()) if seen else np.ones(len(langs))
    scripts = {s: m >= 0.01 * np.maximum(total, 1) for s, m in seen.items()}
    counts += 0.5
    return Model(langs, {s: m for s, m in scripts.items() if m.any()}, np.log(counts / counts.sum(axis=1, keepdims=True)))


def viterbi(scores: np.ndarray, lengths: np.ndarray, penalty: float) -> np.ndarray:
    """Best language of every word; ``scores`` holds the texts one after another.

    Each text's path has the greatest sum of scores less ``penalty`` for every switch;
    of equal paths the one that stays, then the lower language, is taken.
    """
    n_lang = scores.shape[1]
    if n_lang == 0 or not len(scores):
        return np.zeros(len(scores), np.int64)
    block = BLOCK * n_lang  # so that a matrix a block is linear in languages
    blocks = -(-lengths // block)
    block_text = np.repeat(np.arange(len(lengths)), blocks)
    inside = np.arange(len(block_text)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    starts = (np.cumsum(lengths) - lengths)[block_text] + inside * block
    sizes = np.minimum(lengths[block_text] - inside * block, block)
    longest = int(sizes.max())
    order = np.argsort(-sizes, kind="stable")  # blocks that are still going on come first
    going = np.searchsorted(-sizes[order], -np.arange(longest), "left")
    # value[b, s, l]: the best path through block b that enters in language s and is in l now
    value = np.full((len(starts), n_lang, n_lang), -np.inf)
    value[:, np.arange(n_lang), np.arange(n_lang)] = 0.0
    for t in range(longest):
        now = value[: going[t]]
        value[: going[t]] = np.maximum(now, now.max(axis=2, keepdims=True) - penalty) + scores[starts[order[: going[t]]] + t][:, None, :]
    value[order] = value.copy()
    # Chain the blocks of each text: enter[b] is the language before block b.
    total = np.zeros((len(lengths), n_lang))
    back = np.zeros((len(starts), n_lang), np.int64)
    for k in range(int(blocks.max())):
        at = np.flatnonzero(inside == k)
        through = total[block_text[at]][:, :, None] + value[at]
        back[at] = through.argmax(axis=1)
        total[block_text[at]] = through.max(axis=1)
    exit_ = np.zeros(len(starts), np.int64)
    enter = np.zeros(len(starts), np.int64)
    now = total.argmax(axis=1)
    for k in range(int(blocks.max()) - 1, -1, -1):
        at = np.flatnonzero(inside == k)
        exit_[at] = now[block_text[at]]
        enter[at] = back[at, exit_[at]]
        now[block_text[at]] = enter[at]
    # Once more through the blocks, from the known entries, noting where each language came from.
    path = np.full((len(starts), n_lang), -np.inf)
    path[np.arange(len(starts)), enter[order]] = 0.0
    came = np.empty((longest, len(starts), n_lang), np.int8 if n_lang < 127 else np.int16)
    for t in range(longest):
        live = path[: going[t]]
        best = live.argmax(axis=1)
        top = live[np.arange(len(live)), best] - penalty
        switch = top[:, None] > live
        came[t, : going[t]] = np.where(switch, best[:, None], np.arange(n_lang))
        path[: going[t]] = np.where(switch, top[:, None], live) + scores[starts[order[: going[t]]] + t]
    out, state = np.empty(len(scores), np.int64), exit_[order]
    for t in range(longest - 1, -1, -1):
        out[starts[order[: going[t]]] + t] = state[: going[t]]
        state[: going[t]] = came[t, np.arange(going[t]), state[: going[t]]]
    return out


class Labeller:
    """Spans and predictions of batches of texts; remembers the scores of recent tokens."""

    def __init__(self, model: Model, penalty: float = PENALTY):
        self.model, self.penalty = model, penalty
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.first, self.count = np.empty(0, np.int64), np.empty(0, np.int64)  # each token's pieces
        self.table, self.letters, self.strange = np.empty((0, len(self.model.langs)), np.float32), np.empty(0, np.int64), np.empty(0, bool)

    def labels(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Language and letters of every piece, pieces of every text, and each piece's word in its text.

        Pieces of a script that was never learned have no language: the number after the last.
        """
        split = [t.split() for t in texts]
        if max(len(self.known), len(self.letters)) > REMEMBERED:
            self.forget()
        new = list({w for x in split for w in x} - self.known.keys())
        pieces = list(map(pieces_of, new))
        count = np.fromiter(map(len, pieces), np.int64, len(pieces))
        scores, letters, strange = self.model.scores([p for x in pieces for p in x])
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
        self.first, self.count = np.concatenate([self.first, len(self.letters) + np.cumsum(count) - count]), np.concatenate([self.count, count])
        self.table, self.letters, self.strange = np.concatenate([self.table, scores]), np.concatenate([self.letters, letters]), np.concatenate([self.strange, strange])
        get = self.known.__getitem__
        words = np.array([len(x) for x in split], np.int64)
        token = np.fromiter((k for x in split for k in map(get, x)), np.int64, int(words.sum()))
        count = self.count[token]
        at = np.repeat(self.first[token] - np.cumsum(count) + count, count) + np.arange(count.sum())
        lengths = np.bincount(np.repeat(np.arange(len(texts)), words), weights=count, minlength=len(texts)).astype(np.int64)
        word = np.repeat(np.arange(len(token)) - np.repeat(np.cumsum(words) - words, words), count)
        found = viterbi(self.table[at], lengths, self.penalty)
        return np.where(self.strange[at], len(self.model.langs), found), self.letters[at], lengths, word

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        """The language with the most letters, and its share of all letters; ``und`` and 0 without letters of a learned script."""
        found, letters, lengths, _ = self.labels(texts)
        n = len(self.model.langs)
        if not n:
            return ["und"] * len(texts), [0.0] * len(texts)
        text = np.repeat(np.arange(len(texts)), lengths)
        share = np.bincount(text * (n + 1) + found, weights=letters, minlength=len(texts) * (n + 1)).reshape(-1, n + 1)
        all_, share = share.sum(axis=1), share[:, :n]
        best, most = share.argmax(axis=1), share.max(axis=1)
        names = [self.model.langs[b] if m else "und" for m, b in zip(most, best, strict=True)]
        return names, (most / np.maximum(all_, 1)).tolist()

    def spans(self, texts: list[str]) -> list[list[dict]]:
        """Runs of one language in each text: start and end word, and the language (``und``: letters of no learned script).

        A word whose pieces are of several languages is in the spans of all of them.
        """
        found, _, lengths, word = self.labels(texts)
        names, out, at = [*self.model.langs, "und"], [], 0
        for n in lengths.tolist():
            labels, words = found[at : at + n], word[at : at + n]
            cut = [0, *(np.flatnonzero(np.diff(labels)) + 1).tolist(), n] if n else []
            out.append([{"start": int(words[a]), "end": int(words[b - 1]) + 1, "lang": names[labels[a]]} for a, b in zip(cut, cut[1:])])
            at += n
        return out


def model_of(docs: DataFrame, most: int = 1000) -> Model:
    """Learned from at most about ``most`` documents of each language outside the held-out fold.

    Rows with a null id, language or text aren't learned from; documents are chosen by a
    hash of the id.
    """
    rated = pick(docs, k="doc_id", y="lang", t="text").dropna().filter(~held_out(F.col("k"), FOLDS, TEST_FOLD))
    counts = rated.groupBy("y").agg(F.count("*").alias("n"))
    share = F.broadcast(counts.select("y", F.least(F.lit(1.0), F.lit(float(most)) / F.col("n")).alias("share")))  # a row a language
    chosen = rated.join(share, "y").filter(F.pmod(F.xxhash64("k", F.lit("sample")), F.lit(1 << 30)) < F.col("share") * (1 << 30))
    return fit(sorted((r[0], r[1]) for r in chosen.select("y", "t").collect()))


def predicted(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score`` of every whole text."""
    kind = docs.schema.fields[docs.columns.index(id_col)].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(sent.value)
        for batch in batches:
            names, shares = [], []
            for _, texts in slices(batch.column("t")):
                a, b = labeller.predict([t or "" for t in texts.to_pylist()])
                names += a
                shares += b
            yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array(names, pa.string()), pa.array(shares, pa.float64())], ["doc_id", "lang_pred", "score"])

    return pick(docs, k=id_col, t=text_col).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def labelled_spans(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, spans array<struct<start, end, lang>>`` over the words of every whole text."""
    kind = docs.schema.fields[docs.columns.index(id_col)].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model)
    type_ = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(sent.value)
        for batch in batches:
            for first, texts in slices(batch.column("t")):
                spans = labeller.spans([t or "" for t in texts.to_pylist()])
                yield pa.RecordBatch.from_arrays([batch.column("k").slice(first, len(texts)), pa.array(spans, type_)], ["doc_id", "spans"])

    return pick(docs, k=id_col, t=text_col).mapInArrow(run, f"doc_id {kind}, spans array<struct<start: int, end: int, lang: string>>")


def identified(docs: DataFrame, most: int = 1000) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every document.

    ``lang_pred`` is a learned language, or ``und`` where the text is null or has no
    letter of a learned script; ``score`` is the share of all letters that are in its spans.
    Null ids are never held out; repeated rows stay; an empty table gives an empty table.
    """
    out = predicted(docs, model_of(docs, most))
    return out.select("doc_id", held_out(F.col("doc_id"), FOLDS, TEST_FOLD).alias("held_out"), "lang_pred", "score")


def in_one_language(docs: DataFrame, least: float = 0.5, most: int = 1000, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with a predicted language whose spans hold at least ``least`` of the letters.

    Null and empty texts and texts without letters of a learned script go; repeated rows and
    rows with a null id are judged by their text like any other.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model_of(docs, most))

    def decider():
        labeller = Labeller(sent.value)

        def decide(texts: list[str]) -> list[bool]:
            return [lang != "und" and share >= least for lang, share in zip(*labeller.predict(texts), strict=True)]

        return decide

    return masked(docs, text_col, decider)
