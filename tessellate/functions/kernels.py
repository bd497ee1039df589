"""Tokens, sentences and chunks of one text, in plain Python.

A token is a tuple (type, start, end, after a line break); positions are code points.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import regex

from ..types import NUMBER, PUNCTUATION, WORD, SentenceRangeError, TokenIntervalError
from .text import ABBREVIATIONS, CLOSING, END_MARKS

Token = tuple[int, int, int, bool]
Tokenizer = Callable[[str], list[Token]]
_TOKEN = regex.compile(r"(?P<word>[^\W\d_]+)|(?P<number>\d+)|([^\w\s]|_)\3*")
_CLOSERS = "".join(CLOSING)
_GRAPHEME = regex.compile(r"\X")
_SCRIPTS = {name: regex.compile(rf"\p{{{name}}}") for name in ("Latin", "Cyrillic", "Greek", "Arabic", "Hebrew", "Devanagari")}
_UNSPACED = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]")


def regex_tokens(text: str) -> list[Token]:
    """Runs of letters, runs of digits, runs of one symbol.  The first token is never after a break."""
    out, last = [], 0
    for m in _TOKEN.finditer(text):
        kind = WORD if m["word"] else NUMBER if m["number"] else PUNCTUATION
        gap = text[last : m.start()]
        out.append((kind, m.start(), m.end(), bool(out) and ("\n" in gap or "\r" in gap)))
        last = m.end()
    return out


def _kind(cluster: str) -> int:
    return {"L": WORD, "N": NUMBER}.get(unicodedata.category(cluster[0])[0], PUNCTUATION)


def _script(cluster: str) -> str | None:
    if cluster[0].isascii():
        return "Latin"
    return next((name for name, pattern in _SCRIPTS.items() if pattern.match(cluster)), None)


def unicode_tokens(text: str) -> list[Token]:
    """Grapheme clusters, joined while they go on in one script, number or repeated symbol.

    Scripts written without spaces give a token a cluster.  A break before the first token counts.
    """
    out: list[Token] = []
    open_, break_ = False, False
    script, tail = None, ""
    for m in _GRAPHEME.finditer(text):
        cluster = m[0]
        if cluster.isspace():
            open_, break_ = False, break_ or "\n" in cluster or "\r" in cluster
            continue
        kind = _kind(cluster)
        now = _script(cluster) if kind == WORD and not _UNSPACED.match(cluster) else None
        same = open_ and out[-1][0] == kind and (kind == NUMBER or (kind == WORD and now is not None and now == script) or (kind == PUNCTUATION and cluster == tail))
        if same:
            out[-1] = (kind, out[-1][1], m.end(), out[-1][3])
        else:
            out.append((kind, m.start(), m.end(), break_))
        open_, break_, script, tail = True, False, now, cluster
    return out


TOKENIZERS: dict[str, Tokenizer] = {"regex": regex_tokens, "unicode": unicode_tokens}


def tokenizer_of(choice: str | Tokenizer) -> Tokenizer:
    """A built-in tokenizer by name, or a callable of one's own."""
    return TOKENIZERS[choice] if isinstance(choice, str) else choice


def tokens_text(text: str, tokens: list[Token], start: int, end: int) -> str:
    """Text from the first to the last token of an interval; an empty interval is empty."""
    if start == end:
        return ""
    if not 0 <= start < end <= len(tokens):
        raise TokenIntervalError(f"[{start}, {end}) is no interval of {len(tokens)} tokens")
    return text[tokens[start][1] : tokens[end - 1][2]]


class Sentences:
    """Where the sentences of a text end; found once, in one pass from the back.

    A sentence goes from its start up to an end mark with the closers after it, a line break
    before a token that isn't lower case, or the text's end.  An abbreviation's mark ends a
    sentence only if the sentence starts with it.
    """

    def __init__(self, text: str, tokens: list[Token], abbreviations: tuple[str, ...] = ABBREVIATIONS):
        words = [text[t[1] : t[2]] for t in tokens]
        n = len(words)
        closed = list(range(1, n + 1))  # the end after a mark and the closers that follow it
        for k in range(n - 2, -1, -1):
            if words[k + 1] in CLOSING:
                closed[k] = closed[k + 1]
        self.marks, self.ends = [0] * n, [n] * n  # the end if the sentence starts here: by this token, by any
        for k in range(n - 1, -1, -1):
            mark = tokens[k][0] == PUNCTUATION and words[k].rstrip(_CLOSERS).endswith(END_MARKS)
            self.marks[k] = closed[k] if mark else 0
            if mark and not (k and words[k - 1] + words[k] in abbreviations):
                self.ends[k] = closed[k]
            elif k + 1 < n:
                self.ends[k] = k + 1 if tokens[k + 1][3] and not words[k + 1][0].islower() else self.ends[k + 1]

    def end(self, start: int) -> int:
        return self.marks[start] or self.ends[start]


def sentence_range(text: str, tokens: list[Token], start: int, abbreviations: tuple[str, ...] = ABBREVIATIONS) -> tuple[int, int]:
    """The sentence that starts at a token (:class:`Sentences`)."""
    if not tokens:
        return 0, 0
    if not 0 <= start < len(tokens):
        raise SentenceRangeError(f"token {start} of {len(tokens)}")
    return start, Sentences(text, tokens, abbreviations).end(start)


def sentences(text: str, tokens: list[Token], start: int = 0) -> Iterator[tuple[int, int]]:
    """Successive sentences from a token on."""
    if not 0 <= start <= len(tokens):
        raise IndexError(f"token {start} of {len(tokens)}")
    found = Sentences(text, tokens)
    while start < len(tokens):
        end = found.end(start)
        yield start, end
        start = end


def chunks(text: str, tokens: list[Token], max_chars: int) -> Iterator[tuple[int, int]]:
    """Token intervals that cover all tokens once, in order, of at most ``max_chars`` where tokens allow.

    Whole sentences are put together while they fit.  A sentence that is too long is cut at
    its last line start, or else after the last token that fits; the rest of a cut sentence
    is not put together with what follows.
    """
    fits = lambda a, b: tokens[b - 1][2] - tokens[a][1] <= max_chars
    found, at, rest_of_cut = Sentences(text, tokens), 0, False
    while at < len(tokens):
        end = found.end(at)
        if not fits(at, at + 1):
            stop, rest_of_cut = at + 1, at + 1 < end
        elif not fits(at, end):
            over = next(k for k in range(at + 1, end) if not fits(at, k + 1))
            stop = next((k for k in range(over, at, -1) if tokens[k][3]), over)
            rest_of_cut = True
        else:
            stop = end
            if rest_of_cut:
                rest_of_cut = False
            else:
                while stop < len(tokens) and fits(at, more := found.end(stop)):
                    stop = more
        yield at, stop
        at = stop
