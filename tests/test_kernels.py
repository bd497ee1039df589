"""Tokens, sentences, chunks (T1-T11, C1-C9) and grounding (A1-A13) of single texts, against plain versions."""

import difflib
import random
import time
import unicodedata

import pytest

from tessellate.functions import alignment, formats, kernels
from tessellate.functions import tokens as tokens_module
from tessellate.functions.alignment import Options, align, lcs_match, lcs_spans
from tessellate.types import NUMBER, PUNCTUATION, WORD, SentenceRangeError, TokenIntervalError

#: Texts of the tests: everyday prose about baking, with line breaks, quotes, figures and odd characters.
BREAD = "Rye dough rests overnight. Prof. Lund kneads 2 loaves (one is burnt!)\nand sells none; why bother?\n\nNobody knows. \"Ask the oven.\" it whirs\nOn Sundays"
ODD = ["", " \n\t", "oven_7--mitt", "½ cup, 3²", "Crème brûlée:\r\n٣ eggs", "a\x0bb\x1cc", "🥖🥖🍞 10%%%!", "x" * 70 + " 1" * 9, "\n\n(Salt.)\nflour", "Teig. Ofen.\rBrot\nkrume"]
WORDS = ["rye", "Rye", "dough", "Prof", "Dr", "St", ".", "!", "?!", "\"", "”", ")", "(", "12", "7", ",", "\n", "\r\n", " \n ", "_", "--", "é", "Ölkrug", "。"]


def made_up(rng, size=40):
    return "".join(rng.choice(WORDS) + rng.choice(["", " ", " "]) for _ in range(rng.randrange(size)))


TEXTS = [BREAD, *ODD, *(made_up(random.Random(k)) for k in range(300))]


# -- plain versions --------------------------------------------------------------------


def kind_of(ch):
    if kernels.regex.match(r"\s", ch):
        return None
    if unicodedata.category(ch) == "Nd":
        return NUMBER
    return WORD if ch != "_" and kernels.regex.match(r"\w", ch) else PUNCTUATION


def plain_tokens(text):
    """A token grows by one character as long as that is of its kind (symbols: the same symbol)."""
    out, gap = [], ""
    for k, ch in enumerate(text):
        kind = kind_of(ch)
        if kind is None:
            gap += ch
        elif out and out[-1][2] == k and out[-1][0] == kind and (kind != PUNCTUATION or text[k - 1] == ch):
            out[-1][2] = k + 1
        else:
            out.append([kind, k, k + 1, bool(out) and ("\n" in gap or "\r" in gap)])
            gap = ""
    return [tuple(t) for t in out]


def plain_end(text, tokens, start, abbreviations=kernels.ABBREVIATIONS):
    """Walks from the start token to the sentence's end."""
    words = [text[t[1] : t[2]] for t in tokens]
    for k in range(start, len(words)):
        mark = tokens[k][0] == PUNCTUATION and words[k].rstrip("\"'”’»)]}")[-1:] in tuple(".?!。！？।")
        if mark and not (k > start and words[k - 1] + words[k] in abbreviations):
            while k + 1 < len(words) and words[k + 1] in kernels.CLOSING:
                k += 1
            return k + 1
        if k + 1 < len(words) and tokens[k + 1][3] and not words[k + 1][0].islower():
            return k + 1
    return len(words)


def plain_chunks(text, tokens, most):
    """Cuts one chunk after the other, measuring every candidate anew."""
    fits = lambda a, b: tokens[b - 1][2] - tokens[a][1] <= most
    at, alone = 0, False
    while at < len(tokens):
        end = plain_end(text, tokens, at)
        if fits(at, end):
            stop = end
            while not alone and stop < len(tokens) and fits(at, plain_end(text, tokens, stop)):
                stop = plain_end(text, tokens, stop)
            alone = False
        else:
            fitting = [b for b in range(at + 1, end) if fits(at, b)]
            if fitting:
                lines = [k for k in range(at + 1, fitting[-1] + 1) if tokens[k][3]]
                stop, alone = (lines or fitting)[-1], True
            else:
                stop, alone = at + 1, at + 1 < end
        yield at, stop
        at = stop


def common(a, b):
    """Length of the longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        row = _next(row, x, b)
    return row[-1]


def _next(row, x, b):
    out = [0]
    for j, y in enumerate(b):
        out.append(max(row[j + 1], out[j], row[j] + (x == y)))
    return out


def plain_spans(source, wanted):
    """For each number of matches the shortest span that has so many, the first of several."""
    best = {}
    for end in range(len(source)):
        for start in range(end, -1, -1):
            for k in range(1, common(source[start : end + 1], wanted) + 1):
                if k not in best or end - start < best[k][1] - best[k][0]:
                    best[k] = (start, end)
    return best


# -- tokens ----------------------------------------------------------------------------


def test_t1_t2_t3_regex_tokens_are_plain_tokens():
    for text in TEXTS:
        assert kernels.regex_tokens(text) == plain_tokens(text), text


def test_t1_t2_t3_a_text_by_hand():
    text = "Proof 45 min\nat 26C... _ok"
    assert [(text[a:b], k, n) for k, a, b, n in kernels.regex_tokens(text)] == [
        ("Proof", WORD, False), ("45", NUMBER, False), ("min", WORD, False), ("at", WORD, True), ("26", NUMBER, False), ("C", WORD, False), ("...", PUNCTUATION, False), ("_", PUNCTUATION, False), ("ok", WORD, False),
    ]


@pytest.mark.parametrize(
    "text,words,kinds",
    [
        ("パン焼き、完了。", list("パン焼き、完了。"), "WWWWPWWP"),
        ("25克糖", ["25", "克", "糖"], "NWW"),
        ("Brot🧑🏽‍🍳面包8", ["Brot", "🧑🏽‍🍳", "面", "包", "8"], "WPWWN"),
        ("ryeхлебψωμί", ["rye", "хлеб", "ψωμί"], "WWW"),
        ("!!?é1", ["!!", "?", "é", "1"], "PPWN"),
    ],
)
def test_t4_unicode_tokens(text, words, kinds):
    tokens = kernels.unicode_tokens(text)
    assert [text[a:b] for _, a, b, _ in tokens] == words and "".join("WNP"[t[0]] for t in tokens) == kinds


def test_t4_text_without_spaces_is_cut_at_clusters():
    text = "ขนมปังอร่อย"
    tokens = kernels.unicode_tokens(text)
    assert len(tokens) > 5 and "".join(text[a:b] for _, a, b, _ in tokens) == text


def test_t4_break_before_the_first_token_counts():
    assert kernels.unicode_tokens("\r\noven on")[0][3] and not kernels.regex_tokens("\r\noven on")[0][3]


def test_t5_t6_tokenizers_by_name_or_own():
    assert kernels.tokenizer_of("regex") is kernels.regex_tokens
    own = lambda text: [(0, 0, len(text), False)]
    assert kernels.tokenizer_of(own) is own


def test_t7_tokens_text():
    tokens = kernels.regex_tokens(BREAD)
    assert kernels.tokens_text(BREAD, tokens, 0, 5) == "Rye dough rests overnight." and kernels.tokens_text(BREAD, tokens, 4, 4) == ""
    for bad in ((6, 5), (0, 999), (-2, 3)):
        with pytest.raises(TokenIntervalError):
            kernels.tokens_text(BREAD, tokens, *bad)


# -- sentences and chunks --------------------------------------------------------------


@pytest.mark.parametrize("tokenizer", ["regex", "unicode"])
def test_t8_t9_t10_sentences_are_plain_sentences(tokenizer):
    for text in TEXTS:
        tokens = kernels.TOKENIZERS[tokenizer](text)
        for start in range(len(tokens)):
            assert kernels.sentence_range(text, tokens, start) == (start, plain_end(text, tokens, start)), (text, start)
    assert kernels.sentence_range("", [], 0) == (0, 0)


def test_t10_t11_sentences_of_a_text():
    tokens = kernels.regex_tokens(BREAD)
    found = [kernels.tokens_text(BREAD, tokens, a, b) for a, b in kernels.sentences(BREAD, tokens)]
    assert found == ["Rye dough rests overnight.", "Prof. Lund kneads 2 loaves (one is burnt!)", "and sells none; why bother?", *found[3:]]
    assert "".join(found).replace(" ", "").replace("\n", "") == "".join(BREAD.split())


def test_t11_starts_and_abbreviations():
    text = "Gebr. Holt backen. Ende"
    tokens = kernels.regex_tokens(text)
    assert kernels.sentence_range(text, tokens, 0) == (0, 2) and kernels.sentence_range(text, tokens, 0, ("Gebr.",)) == (0, 5)
    for bad in (-1, 7):
        with pytest.raises(SentenceRangeError):
            kernels.sentence_range(text, tokens, bad)
    with pytest.raises(IndexError):
        list(kernels.sentences(text, tokens, 8))


@pytest.mark.parametrize("most", [1, 6, 15, 40, 90])
def test_c1_c2_chunks_are_plain_chunks(most):
    for text in TEXTS:
        tokens = kernels.regex_tokens(text)
        spans = list(kernels.chunks(text, tokens, most))
        assert spans == list(plain_chunks(text, tokens, most)), (text, most)
        assert [k for a, b in spans for k in range(a, b)] == list(range(len(tokens)))
        assert all(b - a == 1 or tokens[b - 1][2] - tokens[a][1] <= most for a, b in spans)


def test_c1_c2_a_text_by_hand():
    text = "Sift flour. Add salt.\nThen stir the batter\nuntil smooth and let it stand. Bake."
    tokens = kernels.regex_tokens(text)
    shown = lambda most: [kernels.tokens_text(text, tokens, a, b) for a, b in kernels.chunks(text, tokens, most)]
    assert shown(25) == ["Sift flour. Add salt.", "Then stir the batter", "until smooth and let it", "stand.", "Bake."]
    assert shown(500) == [text]


# -- grounding -------------------------------------------------------------------------


def ground(text, *extractions, **options):
    return [g and (g.status.removeprefix("match_"), text[g.char_start : g.char_end]) for g in align(text, list(extractions), Options(**options))]


RECIPE = "Whisk three eggs with brown sugar; fold in roasted hazelnuts and sea-salt before baking."


@pytest.mark.parametrize(
    "extractions,options,want",
    [
        (["eggs", "Brown Sugar", "sea-salt"], {}, [("exact", "eggs"), ("exact", "brown sugar"), ("exact", "sea-salt")]),
        (["haz"], {}, [None]),
        (["roasted hazelnuts and almonds"], {}, [("lesser", "roasted hazelnuts and")]),
        (["roasted hazelnuts and almonds"], {"accept_lesser": False}, [("fuzzy", "roasted hazelnuts and")]),
        (["roasted hazelnuts and almonds"], {"accept_lesser": False, "enable_fuzzy": False}, [None]),
        (["finely roasted hazelnuts and"], {}, [("fuzzy", "roasted hazelnuts and")]),
        (["with sugar fold"], {"accept_lesser": False}, [("fuzzy", "with brown sugar; fold")]),
        (["brown egg"], {"accept_lesser": False}, [None]),
        (["copper kettle"], {}, [None]),
        (["three eggs hazelnuts baking"], {"accept_lesser": False}, [None]),
        (["three egg"], {"accept_lesser": False}, [("fuzzy", "three eggs")]),
        (["three egg"], {"accept_lesser": False, "algorithm": "legacy"}, [("fuzzy", "three eggs")]),
    ],
)
def test_a3_a6_a9_a10_alignment(extractions, options, want):
    assert ground(RECIPE, *extractions, **options) == want


def test_a3_words_that_occur_once_are_found_where_they_stand():
    """Stretches of a text of distinct words, alone: exact where they stand; with strange words behind them: lesser."""
    rng = random.Random(4)
    for _ in range(100):
        words = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in rng.sample(range(200), rng.randint(3, 40))]
        text = " ".join(words)
        a = rng.randrange(len(words))
        b = rng.randint(a + 1, len(words))
        piece = " ".join(words[a:b])
        assert ground(text, piece) == [("exact", piece)] and ground(text, piece + " zz zz") == [("lesser", piece)]
        (g,) = align(text, [piece], token_offset=7, char_offset=90)
        assert (g.token_start, g.token_end, g.char_start) == (a + 7, b + 7, text.index(piece) + 90)


def test_a3_blocks_are_those_of_a_general_diff():
    """Longest stretch first, on few letters (many ties) and many, with delimiters as in joint matches."""
    rng = random.Random(12)
    for _ in range(1500):
        letters = "abcdefghijklmnop|"[: rng.choice([1, 2, 3, 5, 17])]
        source, wanted = rng.choices(letters, k=rng.randrange(40)), rng.choices(letters + "|", k=rng.randrange(25))
        general = difflib.SequenceMatcher(None, source, wanted, autojunk=False).get_matching_blocks()
        assert alignment.matching_blocks(source, wanted) == [tuple(b) for b in general if b.size], (source, wanted)


def test_a3_common_words_dont_make_it_slow():
    """30,000 tokens of which most occur in most extractions."""
    rng = random.Random(13)
    source = rng.choices(["the", "of", "and", *(f"w{k}" for k in range(300))], weights=[200, 200, 200, *[1] * 300], k=30_000)
    wanted = [w for k in range(0, 3000, 100) for w in [*source[k * 9 : k * 9 + 12], "␟"]]
    began = time.process_time()
    blocks = alignment.matching_blocks(source, wanted)
    assert time.process_time() - began < 10 and sum(b[2] for b in blocks) >= 300


def test_a2_normalized_tokens():
    assert [alignment.normalized(t) for t in ("Loaves", "bass", "bus", "us", "Ovens")] == ["loave", "bass", "bus", "us", "oven"]


def test_a6_spans_are_plain_spans():
    rng = random.Random(9)
    for _ in range(150):
        letters = "abcd"[: rng.randint(1, 4)]
        source, wanted = [rng.choices(letters, k=rng.randint(1, n)) for n in (12, 5)]
        assert lcs_spans(source, wanted) == plain_spans(source, wanted), (source, wanted)


def test_a7_a8_matches_are_the_most_that_pass_the_gates():
    rng = random.Random(11)
    for _ in range(150):
        source, wanted = rng.choices("abcdef", k=rng.randint(1, 25)), rng.choices("abcdef", k=rng.randint(1, 6))
        options = Options(threshold=rng.choice([0.5, 0.75, 1.0]), min_density=rng.choice([0.2, 1 / 3, 0.9]))
        spans = plain_spans(source, wanted)
        passing = [k for k, (a, b) in spans.items() if k >= options.threshold * len(wanted) and k >= options.min_density * (b - a + 1)]
        want = (spans[max(passing)][0], spans[max(passing)][1] + 1) if passing else None
        assert lcs_match(source, wanted, options) == want, (source, wanted, options)


def test_a4_a5_what_raises():
    for text, extractions in (("", ["rye"]), ("rye", [""]), ("rye", ["␟"]), ("rye ␟ bran", ["rye", "bran"])):
        with pytest.raises(ValueError):
            align(text, extractions)
    for bad in ({"algorithm": "guess"}, {"threshold": 1.5}, {"min_density": -0.1}):
        with pytest.raises(ValueError):
            Options(**bad)
    assert align("rye", []) == []


def test_m1_overlap():
    g = lambda a, b: alignment.Grounding("x", 0, 1, a, b)
    assert not alignment.overlap(g(3, 8), g(8, 9)) and alignment.overlap(g(3, 9), g(8, 12)) and not alignment.overlap(g(0, 1), None)


def test_t1_t8_c1_arrays_are_the_single_text_versions():
    """All texts at once, and text by text."""
    found = tokens_module.Tokens(TEXTS)
    shown, (heads, tails) = found.strings().to_pylist(), found.sentences()
    cut = {most: found.chunks(most) for most in (1, 6, 15, 90, 1000)}
    for d, text in enumerate(TEXTS):
        a, b, at = int(found.first[d]), int(found.first[d + 1]), found.at[d]
        want = kernels.regex_tokens(text)
        assert list(zip(found.kind[a:b], found.start[a:b] - at, found.end[a:b] - at, found.broken[a:b], strict=True)) == want
        assert shown[a:b] == [text[t[1] : t[2]] for t in want]
        spans = lambda s, e: [(int(x) - a, int(y) - a) for x, y in zip(s, e, strict=True) if a <= x < b]
        assert spans(heads, tails) == list(kernels.sentences(text, want))
        assert all(spans(*c) == list(kernels.chunks(text, want, most)) for most, c in cut.items())
    plain = [t for t in TEXTS if tokens_module.simple(t)] + ["Öl хлеб ψωμί اب 面包 ขนม ½ⅷ٣ $$ __ x²\u2028y", "\n\n(パン) 뺑 12.5%"]
    assert 200 < len(plain) < len(TEXTS) + 2
    found = tokens_module.Tokens(plain, by_script=True)
    heads, tails = found.sentences()
    for d, text in enumerate(plain):
        a, b, at = int(found.first[d]), int(found.first[d + 1]), found.at[d]
        want = kernels.unicode_tokens(text)
        assert list(zip(found.kind[a:b], found.start[a:b] - at, found.end[a:b] - at, found.broken[a:b], strict=True)) == want, text
        assert [(int(x) - a, int(y) - a) for x, y in zip(heads, tails, strict=True) if a <= x < b] == list(kernels.sentences(text, want)), text
    for none in ([], ["", " "]):
        assert len(tokens_module.Tokens(none)) == len(tokens_module.Tokens(none).strings()) == len(tokens_module.Tokens(none).chunks(5)[0]) == 0


def test_t4_simple_characters_are_clusters_by_themselves():
    """Every character that isn't said to join is a cluster of its own, also beside letters and its like."""
    for k in [*range(0x3400), *range(0xA000, 0xD800, 7), *range(0xE000, 0x20000, 5)]:
        ch = chr(k)
        if tokens_module.simple(ch) and ch not in "\r\n":
            assert len(kernels.regex.findall(r"\X", f"a{ch}{ch}b각")) == 5, hex(k)
        wide = f"a{ch}1{ch}" if tokens_module.simple(ch) else "a1"
        tokens = tokens_module.Tokens([wide], by_script=True)
        assert list(zip(tokens.kind, tokens.start, tokens.end, tokens.broken, strict=True)) == kernels.unicode_tokens(wide), hex(k)


def test_r1_fences():
    cases = {
        "no fence": [], "```json\n[1]\n```": [("json", "[1]")], "a ```{}``` b": [("", "{}")], "```YAML x: 1\n```": [("yaml", "x: 1")],
        "```\nopen": [], "```a``` ```b```": [("a", ""), ("b", "")], "```js\n1``` and ```\n2": [("js", "1")], "````": [], "``````": [("", "")],
    }
    for text, want in cases.items():
        assert formats.fenced(text) == want, text
