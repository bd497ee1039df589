"""Grounding of extracted strings in the text they came from, on tokens, in plain Python."""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass
from difflib import SequenceMatcher

import numpy as np

from ..types import DELIMITER, EXACT, FUZZY, LESSER
from .kernels import Token, Tokenizer, regex_tokens


@dataclass(frozen=True)
class Options:
    enable_fuzzy: bool = True
    threshold: float = 0.75
    min_density: float = 1 / 3
    algorithm: str = "lcs"
    accept_lesser: bool = True

    def __post_init__(self):
        if self.enable_fuzzy:
            if self.algorithm not in ("lcs", "legacy"):
                raise ValueError(f"unknown fuzzy algorithm {self.algorithm!r}")
            if not 0 <= self.threshold <= 1 or not 0 <= self.min_density <= 1:
                raise ValueError("threshold and density lie between 0 and 1")


@dataclass(frozen=True)
class Grounding:
    """Where an extraction was found: tokens and code points, both half open."""

    status: str
    token_start: int
    token_end: int
    char_start: int
    char_end: int


def folded(text: str, tokens: list[Token]) -> list[str]:
    return [text[t[1] : t[2]].lower() for t in tokens]


def normalized(token: str) -> str:
    """Lower case without a plural ``s``."""
    token = token.lower()
    return token[:-1] if len(token) > 3 and token.endswith("s") and not token.endswith("ss") else token


def lcs_spans(source: list[str], wanted: list[str]) -> dict[int, tuple[int, int]]:
    """For each number k of matches the tightest source span (inclusive) with k tokens of ``wanted`` in order.

    ``start[j][k]`` is the latest start of a span, ending at the present source token or
    before it, in which k of the first j wanted tokens are matched in order; of equally
    short spans the first stays.
    """
    n = len(wanted)
    never = -1
    start = np.full((n + 1, n + 1), never)
    best: dict[int, tuple[int, int]] = {}
    places: dict[str, list[int]] = {}
    for j, w in enumerate(wanted):
        places.setdefault(w, []).append(j)
    for i, token in enumerate(source):
        if token not in places:
            continue
        fresh = start.copy()
        for j in places[token]:
            through = np.full(n + 1, never)
            through[1] = i
            through[2:] = start[j][1:n]
            fresh[j + 1 :] = np.maximum(fresh[j + 1 :], through)
        start = fresh
        for k in range(1, n + 1):
            s = int(start[n][k])
            if s != never and (k not in best or i - s < best[k][1] - best[k][0]):
                best[k] = (s, i)
    return best


def accepted(matches: int, span: tuple[int, int], length: int, options: Options) -> bool:
    """Whether enough of the extraction matched, densely enough."""
    wide = span[1] - span[0] + 1
    return matches > 0 and matches >= math.ceil(length * options.threshold) and matches / wide >= options.min_density


def lcs_match(source: list[str], wanted: list[str], options: Options) -> tuple[int, int] | None:
    """Half-open source span of the most matches that passes the gates."""
    need = math.ceil(len(wanted) * options.threshold)
    if (Counter(source) & Counter(wanted)).total() < max(1, need):
        return None
    spans = lcs_spans(source, wanted)
    for k in sorted(spans, reverse=True):
        if accepted(k, spans[k], len(wanted), options):
            return spans[k][0], spans[k][1] + 1
    return None


def window_match(source: list[str], wanted: list[str], options: Options) -> tuple[int, int] | None:
    """Half-open window with the best share of matched tokens: the shortest, leftmost of the best."""
    need, counts = int(len(wanted) * options.threshold), Counter(wanted)
    matcher, best, found = SequenceMatcher(autojunk=False, b=wanted), 0.0, None
    for size in range(len(wanted), len(source) + 1):
        for at in range(len(source) - size + 1):
            window = source[at : at + size]
            if (counts & Counter(window)).total() < need:
                continue
            matcher.set_seq1(window)
            share = sum(b.size for b in matcher.get_matching_blocks()) / len(wanted)
            if share > best:
                best, found = share, (at, at + size)
        if best == 1.0:
            break
    return found if best >= options.threshold else None


class Automaton:
    """All stretches of some tokens: the states of a suffix automaton.

    A state stands for stretches that end at the same places; ``longest`` is the length of
    its longest one, ``shorter`` the state of its longest suffix that ends at more places,
    ``ends`` the first place where it ends.
    """

    def __init__(self, tokens: list[str]):
        self.next: list[dict[str, int]] = [{}]
        self.shorter, self.longest, self.ends = [-1], [0], [0]
        last = 0
        for place, token in enumerate(tokens, 1):
            new = self._state({}, 0, self.longest[last] + 1, place)
            at, last = last, new
            while at >= 0 and token not in self.next[at]:
                self.next[at][token] = new
                at = self.shorter[at]
            if at < 0:
                continue
            old = self.next[at][token]
            if self.longest[old] == self.longest[at] + 1:
                self.shorter[new] = old
                continue
            copy = self._state(dict(self.next[old]), self.shorter[old], self.longest[at] + 1, self.ends[old])
            self.shorter[old] = self.shorter[new] = copy
            while at >= 0 and self.next[at].get(token) == old:
                self.next[at][token] = copy
                at = self.shorter[at]

    def _state(self, following: dict[str, int], shorter: int, longest: int, ends: int) -> int:
        self.next.append(following)
        self.shorter.append(shorter)
        self.longest.append(longest)
        self.ends.append(ends)
        return len(self.next) - 1

    def longest_in(self, source: list[str], places: Sequence[int]) -> tuple[int, int, int]:
        """Start in ``source``, start in the tokens, and length of the longest common stretch; the first in the source, then in the tokens.

        Only ``places`` of the source, ascending, have tokens that can match.
        """
        best, state, size, before = (0, 0, 0), 0, 0, -1
        for i in places:
            if i != before + 1:
                state = size = 0
            before, token = i, source[i]
            while state and token not in self.next[state]:
                state = self.shorter[state]
                size = self.longest[state]
            if token in self.next[state]:
                state, size = self.next[state][token], size + 1
                if size > best[2]:
                    best = i + 1 - size, self.ends[state] - size, size
        return best


def matching_blocks(source: list[str], wanted: list[str]) -> list[tuple[int, int, int]]:
    """Common stretches (start in each, length), in order in both: the longest first, then those before and behind it.

    Of equally long ones the first in the source counts, then the first in ``wanted``.
    Finding a stretch takes one pass over those source tokens that ``wanted`` has.
    """
    known = set(wanted)
    places = [i for i, token in enumerate(source) if token in known]
    found, ranges = [], [(0, len(source), 0, len(wanted))]
    while ranges:
        a, b, c, d = ranges.pop()
        own = places[bisect_left(places, a) : bisect_left(places, b)]
        if not own or c == d:
            continue
        i, j, size = Automaton(wanted[c:d]).longest_in(source, own)
        if size:
            found.append((i, c + j, size))
            ranges += [(a, i, c, c + j), (i + size, b, c + j + size, d)]
    out: list[tuple[int, int, int]] = []
    for i, j, size in sorted(found):
        if out and out[-1][0] + out[-1][2] == i and out[-1][1] + out[-1][2] == j:
            i, j, size = out[-1][0], out[-1][1], out.pop()[2] + size
        out.append((i, j, size))
    return out


def align(text: str, extractions: list[str], options: Options = Options(), tokenize: Tokenizer = regex_tokens, token_offset: int = 0, char_offset: int = 0) -> list[Grounding | None]:
    """Where each extraction is in ``text``.

    All extractions are matched at once, joined by a delimiter: a matching block that begins
    at an extraction's first token grounds it, exactly if the block covers it, as a lesser
    match if it covers only its beginning.  What is left is matched fuzzily, one by one.
    """
    if not extractions:
        return []
    tokens = tokenize(text)
    source = folded(text, tokens)
    wanted = [folded(e, tokenize(e)) for e in extractions]
    if not source or not any(wanted):
        raise ValueError("neither the text nor the extractions may be without tokens")
    if any(DELIMITER in e for e in extractions):
        raise ValueError("an extraction contains the delimiter")
    joined, first = [], {}
    for k, words in enumerate(wanted):
        joined += [DELIMITER] if k else []
        if words:
            first[len(joined)] = k
        joined += words
    place = lambda status, a, b: Grounding(status, a + token_offset, b + token_offset, tokens[a][1] + char_offset, tokens[b - 1][2] + char_offset)
    found: list[Grounding | None] = [None] * len(extractions)
    for at, in_joined, size in matching_blocks(source, joined):
        k = first.get(in_joined)
        if k is None:
            continue
        if size > len(wanted[k]):
            raise ValueError("the text contains the delimiter")
        if size == len(wanted[k]) or options.accept_lesser:
            found[k] = place(EXACT if size == len(wanted[k]) else LESSER, at, at + size)
    if options.enable_fuzzy and any(f is None for f in found):
        plain = [normalized(t) for t in source]
        match = lcs_match if options.algorithm == "lcs" else window_match
        for k, words in enumerate(wanted):
            if found[k] is None and words and (span := match(plain, [normalized(w) for w in words], options)):
                found[k] = place(FUZZY, *span)
    return found


def overlap(a: Grounding | None, b: Grounding | None) -> bool:
    return a is not None and b is not None and a.char_start < b.char_end and b.char_start < a.char_end
