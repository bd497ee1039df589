"""Tokens, sentences and chunks of many texts at once, as arrays.

The texts of a batch are one array of code points.  A table gives each code point its
kind; tokens start where the kind changes, so all of them are found without looking at a
character in Python.  Results are those of :mod:`kernels`' tokenizers.
"""

from __future__ import annotations

import unicodedata
from bisect import bisect_right
from functools import cache

import numpy as np
import pyarrow as pa
import regex

from ..types import NUMBER, PUNCTUATION, WORD
from .text import ABBREVIATIONS, CLOSING, END_MARKS

_SPACE = 3
_RUNS = regex.compile(r"(?P<word>[^\W\d_]+)|(?P<number>\d+)|(?P<space>\s+)|(?:[^\w\s]|_)+")


@cache
def kinds() -> np.ndarray:
    """The kind of every code point: word, number, symbol or white space."""
    table = np.full(0x110000, PUNCTUATION, np.uint8)
    for low, high in ((0, 0xD800), (0xE000, 0x110000)):  # without surrogates
        points = np.arange(low, high, dtype="<u4").tobytes().decode("utf-32-le")
        for m in _RUNS.finditer(points):
            kind = {"word": WORD, "number": NUMBER, "space": _SPACE}.get(m.lastgroup, PUNCTUATION)
            table[low + m.start() : low + m.end()] = kind
    return table


#: Scripts whose letters go on in one token, besides Latin in ASCII, and what marks code points that join others to a cluster.
_SCRIPTS = ("Latin", "Cyrillic", "Greek", "Arabic", "Hebrew", "Devanagari")
_JOINING = regex.compile(r"[\p{GCB=Extend}\p{GCB=ZWJ}\p{GCB=SpacingMark}\p{GCB=Prepend}\p{GCB=L}\p{GCB=V}\p{GCB=T}\p{GCB=Regional_Indicator}\p{Extended_Pictographic}]")


@cache
def unicode_kinds() -> tuple[np.ndarray, np.ndarray]:
    """The kind of every code point by its category, and its script: 0 for letters of scripts without spaces between words."""
    kind_of, script = {"L": WORD, "N": NUMBER}, np.zeros(0x110000, np.uint8)
    table = np.fromiter((kind_of.get(unicodedata.category(chr(k))[0], PUNCTUATION) for k in range(0x110000)), np.uint8, 0x110000)
    for low, high in ((0, 0xD800), (0xE000, 0x110000)):
        points = np.arange(low, high, dtype="<u4").tobytes().decode("utf-32-le")
        for k, name in reversed(list(enumerate(_SCRIPTS, 1))):
            for m in regex.finditer(rf"\p{{{name}}}+", points):
                script[low + m.start() : low + m.end()] = k
        for m in regex.finditer(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]+", points):
            script[low + m.start() : low + m.end()] = 0
    script[:128] = 1
    table[[k for k in range(0x3001) if chr(k).isspace()]] = _SPACE
    return table, script


def simple(text: str) -> bool:
    """Whether every character of a text is a cluster by itself."""
    return text.isascii() or _JOINING.search(text) is None


def _points(chars: tuple[str, ...] | str) -> np.ndarray:
    return np.array(sorted(map(ord, chars)), np.uint32)


class Tokens:
    """The tokens of some texts: flat arrays over all of them, and where each text's begin.

    ``start`` and ``end`` count code points of the batch; ``first[d]`` is the first token of
    text d, ``at[d]`` its first code point.
    """

    def __init__(self, texts: list[str], by_script: bool = False):
        """By kinds of characters, or (``by_script``, of :func:`simple` texts) by categories and scripts as ``kernels.unicode_tokens``."""
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.at = np.r_[0, np.cumsum(sizes)]
        self.points = points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
        n = len(points)
        self.kinds = kind = (unicode_kinds()[0] if by_script else kinds())[points]
        new = np.ones(n, bool)
        if n:
            new[1:] = (kind[1:] != kind[:-1]) | ((kind[1:] == PUNCTUATION) & (points[1:] != points[:-1]))
            if by_script:
                script = unicode_kinds()[1][points]
                new[1:] |= (kind[1:] == WORD) & ((script[1:] != script[:-1]) | (script[1:] == 0))
            new[self.at[:-1][sizes > 0]] = True
        edges = np.r_[np.flatnonzero(new), n]
        real = kind[edges[:-1]] != _SPACE if n else np.zeros(0, bool)
        self.start, self.end = edges[:-1][real], edges[1:][real]
        self.kind = kind[self.start]
        self.first = np.searchsorted(self.start, self.at)
        lines = np.r_[0, np.cumsum((points == 10) | (points == 13))]
        before = np.r_[0, self.end[:-1]] if len(self.end) else self.end
        heads = self.first[:-1][self.first[:-1] < self.first[1:]]
        before[heads] = self.at[:-1][self.first[:-1] < self.first[1:]]
        self.broken = lines[self.start] > lines[before]
        if not by_script:
            self.broken[heads] = False

    def __len__(self) -> int:
        return len(self.start)

    def text_of(self) -> np.ndarray:
        """The number of each token's text."""
        return np.repeat(np.arange(len(self.at) - 1), np.diff(self.first))

    def strings(self) -> pa.StringArray:
        """The tokens themselves."""
        width = 1 + (self.points >= 0x80).astype(np.int64) + (self.points >= 0x800) + (self.points >= 0x10000)
        raw = np.frombuffer(self.points.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "replace"), np.uint8)
        ends = np.r_[0, np.cumsum(np.where(self.kinds == _SPACE, 0, width))]
        data = raw[np.repeat(self.kinds != _SPACE, width)]
        offsets = np.r_[0, ends[self.end]] if len(self) else np.zeros(1, np.int64)
        return pa.StringArray.from_buffers(len(self), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data))

    # -- sentences ---------------------------------------------------------------------

    def _one(self, chars: tuple[str, ...] | str) -> np.ndarray:
        """Tokens that are one character, one of ``chars``."""
        return (self.end - self.start == 1) & np.isin(self.points[self.start], _points(chars))

    def _abbreviated(self) -> np.ndarray:
        """Full stops that end an abbreviation with the token before them."""
        out = np.zeros(len(self), bool)
        dots = np.flatnonzero(self._one("."))
        dots = dots[~np.isin(dots, self.first[:-1])]
        for word in ABBREVIATIONS:
            k = dots[self.end[dots - 1] - self.start[dots - 1] == len(word) - 1]
            for j, ch in enumerate(word[:-1]):
                k = k[self.points[self.start[k - 1] + j] == ord(ch)]
            out[k] = True
        return out

    def sentence_ends(self) -> tuple[np.ndarray, np.ndarray]:
        """For each token, where a sentence that starts there ends, and where each text's tokens end (as token numbers)."""
        n = len(self)
        last = self.first[1:][self.text_of()]
        mark = (self.kind == PUNCTUATION) & np.isin(self.points[self.start], _points(END_MARKS))
        others = np.r_[np.flatnonzero(~self._one(CLOSING)), n]
        every = np.arange(n)
        closed = np.minimum(others[np.searchsorted(others, every, "right")] if n else every, last)
        stops = mark & ~self._abbreviated()
        firsts = self.points[self.start[self.broken]].tolist()
        lower = np.fromiter((chr(p).islower() for p in firsts), bool, len(firsts))
        line = np.zeros(n + 1, bool)
        line[:-1][self.broken] = ~lower
        value = np.where(stops, closed, every + 1)
        halts = stops | line[1:] | (every + 1 == last)
        where = np.flatnonzero(halts)
        ends = value[where[np.searchsorted(where, every)]] if n else every
        return np.where(mark, closed, ends), last

    def sentences(self) -> tuple[np.ndarray, np.ndarray]:
        """First tokens and ends of all sentences."""
        ends = self.sentence_ends()[0].tolist()
        starts, at, n = [], 0, len(ends)
        while at < n:  # a text's last sentence ends where the next text starts
            starts.append(at)
            at = ends[at]
        starts = np.array(starts, np.int64)
        return starts, np.r_[starts[1:], n] if n else starts

    # -- chunks ------------------------------------------------------------------------

    def chunks(self, most: int) -> tuple[np.ndarray, np.ndarray]:
        """First tokens and ends of all chunks of at most ``most`` characters where tokens allow.

        Whole sentences while they fit; one that is too long is cut at its last line start
        or after the last token that fits, and the rest of a cut one stays alone.
        """
        ends, last = (x.tolist() for x in self.sentence_ends())
        heads, tails = self.start.tolist(), self.end.tolist()
        lines = np.flatnonzero(self.broken).tolist()
        starts, at, alone, n = [], 0, False, len(ends)
        while at < n:
            starts.append(at)
            end, reach = ends[at], heads[at] + most
            if tails[end - 1] <= reach:
                stop = end
                while not alone and stop < last[at] and tails[ends[stop] - 1] <= reach:
                    stop = ends[stop]
                alone = False
            elif tails[at] > reach:
                stop, alone = at + 1, at + 1 < end
            else:
                stop = bisect_right(tails, reach, at, end)
                line = bisect_right(lines, stop) - 1
                stop, alone = (lines[line] if line >= 0 and lines[line] > at else stop), True
            if stop == last[at]:
                alone = False
            at = stop
        starts = np.array(starts, np.int64)
        return starts, np.r_[starts[1:], n] if n else starts
