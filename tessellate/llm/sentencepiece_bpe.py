"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

A text is cut into words (a run of spaces and what follows, up to the next space).  No
piece of a BPE model with whitespace splitting continues over such a cut, so words merge
independently; this is checked when the model is read.  Distinct new words of a batch are
laid out as one flat symbol array; every round finds the minimum pair rank of each word by
a segmented reduction, merges that pair's leftmost place in all words at once, and
compacts the array; words without a mergeable pair leave.  One merge per word and round
keeps the order of the library's agenda exactly.  Words beyond ``LONG_WORD`` symbols would
need as many rounds, so they take the same greedy order from a heap instead.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import pick

SPACE = "▁"
LONG_WORD = 192
#: Words whose ids a worker remembers; beyond it the memory starts anew.
CACHE_WORDS = 300_000
NO_PAIR = np.iinfo(np.int64).max


class PieceModel:
    """Vocabulary, pair ranks and byte pieces of one model file."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        if sp.normalize("  a \ufb01\t\uff21\n") != f"{SPACE * 3}a{SPACE}\ufb01\t\uff21\n":
            raise ValueError("only models with an identity normaliser and a dummy prefix are supported")
        size = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(size)]
        special = [sp.is_control(i) or sp.is_unknown(i) for i in range(size)]
        self.byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        byte_of = {i: b for b, i in enumerate(self.byte_ids) if sp.is_byte(i)}
        if len(byte_of) != 256:
            raise ValueError("only models with byte fallback are supported")
        self.ids = {p: i for i, p in enumerate(pieces) if not special[i] and i not in byte_of}
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("a piece continues over a space; words can't be merged apart")
        # Characters that occur only inside pieces get symbols of their own, beyond the ids.
        self.symbols = dict(self.ids)
        for p in self.ids:
            for c in p:
                self.symbols.setdefault(c, size + len(self.symbols))
        self.unknown = max(self.symbols.values(), default=size) + 1
        self.base, self.size = self.unknown + 1, size
        self.symbol_of = np.full(0x110000, self.unknown, np.int64)
        for c, i in self.symbols.items():
            if len(c) == 1:
                self.symbol_of[ord(c)] = i
        score = {i: sp.get_score(i) for i in self.ids.values()}
        rank_of = {s: r for r, s in enumerate(sorted(set(score.values()), reverse=True))}
        pairs = {}
        for p, i in self.ids.items():
            for k in range(1, len(p)):
                if (a := self.symbols.get(p[:k])) is not None and (b := self.symbols.get(p[k:])) is not None:
                    pairs[a * self.base + b] = (rank_of[score[i]], i)
        order = sorted(pairs)
        self.pair_keys = np.array([*order, NO_PAIR], np.int64)
        self.pair_ranks = np.array([*(pairs[k][0] for k in order), NO_PAIR], np.int64)
        self.pair_ids = np.array([*(pairs[k][1] for k in order), -1], np.int64)
        self.pairs = pairs
        self.text_of = {i: chr(b).encode("latin-1") for i, b in byte_of.items()}
        self.text_of |= {i: p.replace(SPACE, " ").encode() for p, i in self.ids.items()}
        self.text_of |= {i: b"" if sp.is_control(i) else b" \xe2\x81\x87 " for i in range(size) if special[i]}
        self.byte_of = byte_of
        self.spaced = {i for p, i in self.ids.items() if p.startswith(SPACE)}

    # -- encoding ---------------------------------------------------------------

    def merge_words(self, words: list[str]) -> list[bytes]:
        """Piece ids of each word (spaces given as U+2581), as little-endian 32-bit numbers."""
        out = [b""] * len(words)
        short = []
        for k, w in enumerate(words):
            if len(w) <= LONG_WORD:
                short.append(k)
            else:
                out[k] = np.array(self._named(w, *self._by_heap(w)), "<u4").tobytes()
        if not short:
            return out
        flat = "".join([words[k] for k in short])
        sym = self.symbol_of[np.frombuffer(flat.encode("utf-32-le"), np.uint32)]
        length = np.fromiter((len(words[k]) for k in short), np.int64, len(short))
        sym, width, count = self._rounds(sym, np.repeat(np.arange(len(short)), length), len(short))
        ends = np.cumsum(count)
        packed, e, s = sym.astype("<u4").tobytes(), (ends * 4).tolist(), ((ends - count) * 4).tolist()
        for k, a, b in zip(short, s, e, strict=True):
            out[k] = packed[a:b]
        odd = np.flatnonzero(sym >= self.size)
        for x in np.unique(np.searchsorted(ends, odd, "right")).tolist():  # words with characters that have no piece
            a, b = ends[x] - count[x], ends[x]
            ids = self._named(words[short[x]], sym[a:b].tolist(), width[a:b].tolist())
            out[short[x]] = np.array(ids, "<u4").tobytes()
        return out

    def _rounds(self, sym: np.ndarray, word: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The merged symbols in the order of the words, the characters each covers, symbols of each word."""
        width = np.ones(len(sym), np.int64)
        rank, merged = np.full(len(sym), NO_PAIR), np.full(len(sym), -1)  # of the pair that starts here
        stale = np.flatnonzero(word[:-1] == word[1:])  # pairs to look up
        done = []
        while len(sym):
            keys = sym[stale] * self.base + sym[stale + 1]
            at = np.searchsorted(self.pair_keys, keys)
            hit = self.pair_keys[at] == keys
            rank[stale], merged[stale] = np.where(hit, self.pair_ranks[at], NO_PAIR), self.pair_ids[at]
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            least = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.r_[starts, len(sym)]))
            keep = least != NO_PAIR
            if not keep.all():
                done.append((word[~keep], sym[~keep], width[~keep]))
            best = np.flatnonzero((rank == least) & keep)
            if len(best):  # the leftmost best pair of each word
                best = best[np.r_[True, word[best[1:]] != word[best[:-1]]]]
                sym[best], rank[best] = merged[best], NO_PAIR
                width[best] += width[best + 1]
                keep[best + 1] = False
                touched = np.zeros(len(sym), bool)
                touched[best] = True
                touched = touched[keep]
            sym, word, width, rank, merged = sym[keep], word[keep], width[keep], rank[keep], merged[keep]
            if len(sym):
                here = np.flatnonzero(touched)
                stale = np.concatenate([here[:-1] if len(here) and here[-1] == len(sym) - 1 else here, here[here > 0] - 1])
                stale = stale[word[stale] == word[stale + 1]]
        word, sym, width = (np.concatenate(x) for x in zip(*done, strict=True)) if done else (sym, sym, sym)
        order = np.argsort(word, kind="stable")
        return sym[order], width[order], np.bincount(word, minlength=words)

    def _by_heap(self, text: str) -> tuple[list[int], list[int]]:
        sym = [self.symbols.get(c, self.unknown) for c in text]
        n = len(sym)
        width, after, before = [1] * n, [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(*self.pairs[key], i, a, b) for i, (a, b) in enumerate(zip(sym, sym[1:])) if (key := a * self.base + b) in self.pairs]
        heap = [(r, i, m, a, b) for r, m, i, a, b in heap]
        heapq.heapify(heap)
        while heap:
            _, i, m, a, b = heapq.heappop(heap)
            j = after[i]
            if sym[i] != a or j < 0 or sym[j] != b or not width[i] or not width[j]:
                continue
            sym[i], width[i], width[j], sym[j] = m, width[i] + width[j], 0, -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (found := self.pairs.get(sym[x] * self.base + sym[y])):
                    heapq.heappush(heap, (found[0], x, found[1], sym[x], sym[y]))
        alive = [i for i in range(n) if width[i]]
        return [sym[i] for i in alive], [width[i] for i in alive]

    def _named(self, text: str, symbols: list[int], widths: list[int]) -> list[int]:
        """Symbols to piece ids; a character without a piece becomes its UTF-8 bytes' pieces."""
        ids, at = [], 0
        for s, w in zip(symbols, widths, strict=True):
            if s < self.size:
                ids.append(s)
            else:
                ids.extend(self.byte_ids[b] for b in text[at : at + w].encode())
            at += w
        return ids

    # -- decoding ---------------------------------------------------------------

    def decode(self, ids: list[int]) -> str:
        """Text of ``ids``: the dummy prefix goes; a byte that is no UTF-8 becomes U+FFFD."""
        if not ids:
            return ""
        parts = list(map(self.text_of.__getitem__, ids))
        first = next((k for k, i in enumerate(ids) if i in self.byte_of or parts[k]), None)
        if first is not None and ids[first] in self.spaced:
            parts[first] = parts[first][1:]
        joined = b"".join(parts)
        try:
            return joined.decode()
        except UnicodeDecodeError:
            return "".join(_lenient(parts, ids, self.byte_of))


def _lenient(parts: list[bytes], ids: list[int], byte_of: dict[int, int]) -> Iterator[str]:
    run = b""
    for part, i in zip([*parts, b""], [*ids, None], strict=True):
        if i in byte_of:
            run += part
            continue
        while run:
            for n in (1, 2, 3, 4):
                try:
                    yield run[:n].decode()
                    run = run[n:]
                    break
                except UnicodeDecodeError:
                    continue
            else:
                yield "�"
                run = run[1:]
        yield part.decode()


@lru_cache(4)
def model(path: str) -> PieceModel:
    return PieceModel(path)


def words_of(text: str) -> list[str]:
    """Words as keys: each stands for one space and the key itself."""
    if not text:
        return []
    parts = text.replace(SPACE, " ").split(" ")
    if "" not in parts:
        return parts
    words, extra = [], 0
    for p in parts[:-1]:
        if p:
            words.append(" " * extra + p)
            extra = 0
        else:
            extra += 1
    words.append(" " * extra + parts[-1])
    return words


class Encoder:
    """Encodes batches of texts; remembers the ids of recent words as packed 32-bit numbers."""

    def __init__(self, path: str):
        self.model, self.known = model(path), {}

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        for text in self.grouped(texts):
            yield from text

    def grouped(self, texts: list[str], chars: int = 2_000_000) -> Iterator[list[np.ndarray]]:
        """In groups of about ``chars`` characters, so that the symbol arrays stay small."""
        group, size = [], 0
        for t in texts:
            group.append(t)
            size += len(t)
            if size >= chars:
                yield self._encoded(group)
                group, size = [], 0
        if group:
            yield self._encoded(group)

    def _encoded(self, texts: list[str]) -> list[np.ndarray]:
        split = [words_of(t) for t in texts]
        new = list({w for words in split for w in words} - self.known.keys())
        if len(self.known) + len(new) > CACHE_WORDS:
            self.known.clear()
            new = list({w for words in split for w in words})
        merged = self.model.merge_words([SPACE + w.replace(" ", SPACE) for w in new])
        self.known.update(zip(new, merged, strict=True))
        get = self.known.__getitem__
        return [np.frombuffer(b"".join(map(get, words)), "<u4") for words in split]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, ids array<int>`` of every whole text.

    Null and empty texts have no ids; rows with null or repeated ids are encoded like any
    other; further columns are left out; an empty table gives an empty table.
    """
    return _mapped(docs, path, id_col, text_col, f"{id_col} {_type(docs, id_col)}, ids array<int>", pa.list_(pa.int32()), _ids_only)


def _ids_only(_: PieceModel, ids: np.ndarray) -> list[int]:
    return ids.tolist()


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_tokens, ids_sha256, decoded_sha256`` of every whole text; see :func:`encode`."""
    kind = pa.struct([("n", pa.int64()), ("i", pa.string()), ("d", pa.string())])
    schema = f"{id_col} {_type(docs, id_col)}, x struct<n: bigint, i: string, d: string>"
    out = _mapped(docs, path, id_col, text_col, schema, kind, _digest)
    return out.selectExpr(f"`{id_col}`", "x.n AS n_tokens", "x.i AS ids_sha256", "x.d AS decoded_sha256")


def _digest(m: PieceModel, ids: np.ndarray) -> dict:
    listed = ids.tolist()
    numbers = ",".join(map(str, listed)).encode()
    return {"n": len(listed), "i": hashlib.sha256(numbers).hexdigest(), "d": hashlib.sha256(m.decode(listed).encode()).hexdigest()}


def _type(docs: DataFrame, name: str) -> str:
    return docs.schema.fields[docs.columns.index(name)].dataType.simpleString()


def _mapped(docs: DataFrame, path: str, id_col: str, text_col: str, schema: str, kind: pa.DataType, made: Callable) -> DataFrame:
    last = schema.rpartition(", ")[2] if "struct" not in schema else "x"
    name = last.split(" ")[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        for batch in batches:
            texts = [t or "" for t in batch.column("t").to_pylist()]
            ids, at = batch.column("k"), 0
            for group in encoder.grouped(texts):
                values = pa.array([made(encoder.model, x) for x in group], kind)
                yield pa.RecordBatch.from_arrays([ids.slice(at, len(group)), values], [id_col, name])
                at += len(group)

    return pick(docs, k=id_col, t=text_col).mapInArrow(run, schema)


def decode(tokens: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id_col, text`` decoded from ``ids_col`` (null or empty: empty text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            texts = [m.decode(x or []) for x in batch.column("i").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array(texts, pa.string())], [id_col, "text"])

    return pick(tokens, k=id_col, i=ids_col).mapInArrow(run, f"{id_col} {_type(tokens, id_col)}, text string")
