"""SimHash, SentencePiece, packing, fingerprints and line deduplication against plain versions."""

import hashlib
import random
import re
import zlib
from itertools import combinations

import duckdb
import numpy as np
import pytest
import xxhash

from tessellate.llm import lines, packing, sentencepiece_bpe, simhash, sketch
from tessellate.llm.queries import TOKENIZERS

PIECES, BYTES = f"{TOKENIZERS}/piece_bpe_32k.model", f"{TOKENIZERS}/byte_bpe_50k.json"


# -- simhash -----------------------------------------------------------------------------


def plain_fingerprint(text, words):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps, bits):
    label = {k: k for k in fps}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in combinations(sorted(fps), 2):
        if (fps[a] ^ fps[b]).bit_count() <= bits:
            x, y = find(a), find(b)
            label[max(x, y)] = min(x, y)
    return {k: find(k) for k in fps}


def test_op1_matches_brute_force(docs, texts):
    found = {r[0]: (r[1], r[2]) for r in simhash.grouped(docs).collect()}
    fps = {k: plain_fingerprint(t, 3) for k, t in texts.items()}
    assert {k: v[0] for k, v in found.items()} == {k: f"{f:016x}" for k, f in fps.items()}
    assert {k: v[1] for k, v in found.items()} == plain_components(fps, 3)


def test_op1_edges(edge, empty):
    rows = simhash.grouped(edge).collect()
    assert len(rows) == 11
    zero = {r[0]: r[2] for r in rows if r[1] == "0" * 16}
    assert zero == {3: 3, 4: 3, 6: 3}
    assert {r[0]: r[2] for r in rows if r[0] in (1, 2)} == {1: 1, 2: 1}
    assert simhash.grouped(empty).count() == 0


@pytest.mark.parametrize("bits", [3, 10])
@pytest.mark.parametrize("n,groups", [(0, 1), (1, 1), (300, 1), (1000, 20)])
def test_op1_index_spans_all_components(n, groups, bits):
    rng = np.random.default_rng(n + bits)
    base = rng.integers(0, 2**63, max(1, n // 6), dtype=np.uint64)
    fps = base[rng.integers(0, len(base), n)] if n else np.empty(0, np.uint64)
    for _ in range(4):
        fps = fps ^ np.where(rng.random(n) < 0.6, np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64), np.uint64(0))
    group = rng.integers(0, groups, n)
    i, j = simhash.spanning_links(fps, group, (3, bits))
    assert (np.bitwise_count(fps[i] ^ fps[j]) <= bits).all() and (group[i] == group[j]).all()
    want = {}
    for g in range(groups):
        of_group = {int(k): int(fps[k]) for k in np.flatnonzero(group == g)}
        want |= plain_components(of_group, bits)
    union = simhash._Union(n)
    union.join(i, j)
    assert len(set(zip(union.label.tolist(), [want[k] for k in range(n)]))) == len(set(want.values())) == n - len(i)


def test_op1_large_buckets_are_split_without_loss(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET_ROWS", 3)
    rng = random.Random(5)
    fps = {0}
    while len(fps) < 60:
        f = rng.choice(sorted(fps))
        for _ in range(rng.randint(1, 4)):
            f ^= 1 << rng.randrange(64)
        fps.add(f)
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    edges = [(a % (1 << 64), b % (1 << 64)) for a, b in simhash.links(spark.createDataFrame(signed, "fp bigint"), 3).collect()]
    order = {f: k for k, f in enumerate(sorted(fps))}
    union = simhash._Union(len(order))
    union.join(np.array([order[a] for a, _ in edges]), np.array([order[b] for _, b in edges]))
    want = plain_components({k: f for f, k in order.items()}, 3)
    assert len(set(zip(union.label.tolist(), [want[k] for k in range(len(order))]))) == len(set(want.values())) == len(set(union.label.tolist()))


def test_op1_one_of_each_keeps_the_least_id(spark):
    rng = random.Random(1)
    base = [" ".join(rng.choice("abcdefgh") * 3 + str(rng.randrange(500)) for _ in range(300)) for _ in range(3)]
    near = base[0].split(" ")
    near[150] = "changed"
    rows = [(1, base[0]), (2, base[1]), (3, " ".join(near)), (4, base[2]), (5, base[1]), (None, base[2])]
    kept = simhash.one_of_each(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert sorted(r[0] or -1 for r in kept.collect()) == [-1, 1, 2, 4]


def plain_groups(texts, words=5, least=0.8):
    def shingles(text):
        w = (text or "").lower().split()
        return {" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()

    sets, label = {k: shingles(t) for k, t in texts.items()}, {k: k for k in texts}
    for a, b in combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x == y or 10 * len(x & y) >= 10 * least * len(x | y):
            low, high = sorted((label[a], label[b]))
            label = {k: low if v == high else v for k, v in label.items()}
    return label


def test_pipeline_near_dedup_is_brute_force_jaccard(spark):
    rng = random.Random(7)
    texts, common = {}, [f"c{k}" for k in range(30)]
    for base in range(12):
        words = [f"w{rng.randrange(4000)}" for _ in range(rng.choice([60, 200]))] + common
        for _ in range(12):  # chains of copies; many pairs are just above or below 0.8
            words = [f"x{rng.randrange(10**6)}" if rng.random() < 0.02 else w for w in words]
            texts[len(texts)] = " ".join(words)
    found = {r.doc_id: r.group_id for r in simhash.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")).collect()}
    want = plain_groups(texts)
    assert 12 < len(set(want.values())) < len(texts) and found == want


def test_pipeline_near_dedup_verifies_equal_fingerprints(spark):
    words = lambda p: " ".join(f"{p}{k}" for k in range(40))
    texts = {1: "- " * 100 + words("a"), 2: "- " * 100 + words("b"), 3: words("b"), 4: "- " * 100 + words("b")}
    assert len({simhash.fingerprint(texts[k], 5) for k in (1, 2)}) == 1
    found = {r.doc_id: r.group_id for r in simhash.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")).collect()}
    assert found == plain_groups(texts) and found[2] != 1


# -- sentencepiece -----------------------------------------------------------------------


def odd_texts():
    rng = random.Random(1)
    out = ["", " ", "  a", "a  ", "▁", "x▁ ▁y", "<s> </s> <0x0A>", "\n\n a\tb\r\n", "é" * 500, "ab" * 1000, "a" * 3000, " " * 300 + "x" + " " * 40, "😀 \U0001f9d1‍🚀", "\x00 z"]
    out += ["".join(rng.choice("abcdethinos  \n▁éß日.,!") for _ in range(rng.randint(0, 300))) for _ in range(150)]
    return out + ["".join(chr(rng.choice([rng.randint(32, 0x2FF), rng.randint(0x3000, 0x9FFF)])) for _ in range(60)) for _ in range(50)]


def test_op2_is_the_library(texts):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    ours, all_ = sentencepiece_bpe.Encoder(PIECES), [*odd_texts(), *texts.values()]
    ids = [x.tolist() for x in ours.encode(all_)]
    assert ids == library.encode(all_)
    assert [ours.model.decode(x) for x in ids] == [library.decode(x) for x in ids]
    rng = random.Random(2)
    for _ in range(500):
        x = [rng.choice([rng.randrange(32000), rng.randrange(300)]) for _ in range(rng.randint(0, 12))]
        assert ours.model.decode(x) == library.decode(x)


def test_op2_edges(edge, empty):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rows = {r[0]: r for r in sentencepiece_bpe.digests(edge, PIECES).collect()}
    assert rows[3][1] == rows[4][1] == 0 and rows[3][2] == hashlib.sha256(b"").hexdigest()
    ids = library.encode("word " * 30_000)
    assert rows[5][1:] == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())
    assert sentencepiece_bpe.digests(empty, PIECES).count() == 0
    back = sentencepiece_bpe.decode(sentencepiece_bpe.encode(edge, PIECES), PIECES)
    assert {r[0]: r[1] for r in back.collect()}[7] == "Füße über Straßen\nthe end\nthe end\nThe  END"


# -- packing -----------------------------------------------------------------------------


def check_plan(histogram, capacity):
    runs, bins = packing.plan(histogram, capacity)
    places, ranks = {}, set()
    for n, first, count, b, each, at in runs:
        for k in range(count):
            assert (n, first + k) not in ranks
            ranks.add((n, first + k))
            places.setdefault(b + k // each, []).append((at + k % each * n, n))
    assert ranks == {(n, r) for n, c in histogram.items() for r in range(c)}
    assert sorted(places) == list(range(bins))
    for x in places.values():
        at = 0
        for offset, n in sorted(x):
            assert offset == at
            at += n
        assert at <= capacity
    return bins


@pytest.mark.parametrize("seed", range(4))
def test_op3_plan_is_gapless_and_tight(seed):
    rng = np.random.default_rng(seed)
    lengths = np.clip(rng.lognormal(5.5, 1, 5000), 1, 1024).astype(int)
    histogram = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True))))
    assert check_plan(histogram, 1024) <= 1.02 * max(lengths.sum() / 1024, (lengths > 512).sum())
    assert check_plan({}, 1024) == 0 and check_plan({1024: 3, 1: 1}, 1024) == 4 and check_plan({400: 1000}, 1024) == 500


def test_op3_pieces_and_places(docs, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BYTES)
    rows = packing.pack(docs, BYTES).collect()
    ids = {k: np.array(t.encode(x, add_special_tokens=False).ids + [2], "<u4") for k, x in texts.items()}
    at, filled = dict.fromkeys(ids, 0), {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.piece)):
        assert r.start == at[r.doc_id] and r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
        assert r.length == 1024 or r.piece == 0
        at[r.doc_id] += r.length
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert at == {k: len(x) for k, x in ids.items()}
    for x in filled.values():
        x.sort()
        assert [o for o, _ in x] == [sum(n for _, n in x[:k]) for k in range(len(x))] and sum(n for _, n in x) <= 1024


def test_op3_edges(edge, empty):
    rows = packing.pack(edge, BYTES).collect()
    assert sorted((r.doc_id, r.length) for r in rows if r.doc_id in (3, 4)) == [(3, 1), (4, 1)]
    assert sum(r.doc_id == 7 for r in rows) == 2 and len({(r.sequence_id, r.offset) for r in rows}) == len(rows)
    assert packing.pack(empty, BYTES).count() == 0


def test_op3_segments_give_the_tokenizers_ids():
    t, rng = packing.ByteTokenizer(BYTES), random.Random(3)
    odd = ["", " ", "  a", "a  ", "<|endoftext|>", "a <|endoftext|> b<|endoftext|>", "x \n y", "it's  we'll 's", "a\xa0b \xa0c", "\x1c a \x1c"]
    odd += ["".join(rng.choice("abc 's\n\t  é日.,!1290<|endoftext|>　\x85 \x1c") for _ in range(rng.randint(0, 30))) for _ in range(1000)]
    assert [np.frombuffer(t.encode(x), "<u4").tolist() for x in odd] == [e.ids for e in t.tokenizer.encode_batch(odd, add_special_tokens=False)]


# -- fingerprints ------------------------------------------------------------------------


@pytest.mark.parametrize("blank", [" ", "\n", " \n\t", "\u3000"])
def test_op3_long_white_space(blank):
    tokenizer = packing.tokenizer_of(BYTES)
    for n in (1_999, 2_001, 300_000):
        text = "one two" + blank * n + "three four"
        assert np.frombuffer(tokenizer.encode(text), "<u4").tolist() == tokenizer.tokenizer.encode(text, add_special_tokens=False).ids
    if blank == " ":
        assert len(tokenizer.encode(blank * 2_000_000)) > 4


def plain_sketch(text):
    """Kept hashes of all five-word shingles, by signed value."""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text.lower()) if w]
    found = set()
    for i in range(max(1, len(words) - 4) if words else 0):
        h = 42
        for w in words[i : i + 5]:
            h = xxhash.xxh64_intdigest(w.encode(), h)
        found.add(h)
    signed = sorted(h - (1 << 64) if h >> 63 else h for h in found)
    kept = [h for h in signed if h < -(1 << 63) + (1 << 64) // sketch.SCALE] or signed[:1]
    return [h % (1 << 64) for h in kept]


def test_op5_edited_texts_and_likeness(docs, texts):
    found = {r.doc_id: r for r in sketch.fingerprints(docs).collect()}
    ids, errors = sorted(texts, reverse=True), []
    shingles = lambda t: {tuple(t[i : i + 5]) for i in range(max(1, len(t) - 4))} if t else set()
    for k, i in enumerate(ids):
        t, half = texts[i], len(texts[i]) // 2
        e = t[: len(t) - half] + texts[ids[(k + 1) % len(ids)]][:half]
        r = found[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        a, b = shingles(t.lower().split()), shingles(e.lower().split())
        if len(a | b) > 400:
            errors.append(abs(len(a & b) / len(a | b) - r.near_edited))
        plain = lambda x: "".join(f"{h:016x}" for h in plain_sketch(x))
        assert (r.fingerprint, r.edited_fingerprint) == (plain(t), plain(e))
        u, v, w = (set(plain_sketch(x)) for x in (t, e, texts[ids[(k + 1) % len(ids)]]))
        assert r.near_edited == pytest.approx(len(u & v) / len(u | v) if u | v else 1.0)
        assert r.near_next == pytest.approx(len(u & w) / len(u | w) if u | w else 1.0)
    assert np.mean(errors) < 0.05
    same = {}
    for i, r in found.items():
        assert same.setdefault(texts[i], r.fingerprint) == r.fingerprint


def test_op5_ranges_do_not_change_the_result(docs, monkeypatch):
    want = sorted(tuple(r) for r in sketch.fingerprints(docs.filter("doc_id < 60")).collect())
    whole = sketch.with_next
    monkeypatch.setattr(sketch, "with_next", lambda d: whole(d, rows_a_range=7))
    assert sorted(tuple(r) for r in sketch.fingerprints(docs.filter("doc_id < 60")).collect()) == want


def test_op5_ranges_hold_few_rows_whatever_the_ids(spark):
    ids = spark.range(2000).selectExpr("CASE WHEN id = 7 THEN 1L << 60 WHEN id < 700 THEN 5L ELSE id END AS k", "concat('text ', id) AS t")
    dealt = sketch.with_next(ids, rows_a_range=50).filter("NOT guest").groupBy("range").count().collect()
    assert sum(r["count"] for r in dealt) == 2000 and max(r["count"] for r in dealt) < 400
    words = spark.createDataFrame([(x, f"some words of {x}") for x in "bca"], "doc_id string, text string")
    found = {r.doc_id: r.edited_sha256 for r in sketch.fingerprints(words).collect()}
    assert found["c"] == hashlib.sha256(b"some worsome wo").hexdigest() and len(found) == 3


def test_op5_edges(edge, empty, spark):
    rows = sketch.fingerprints(edge).collect()
    assert len(rows) == 11 and {r.doc_id: r.fingerprint for r in rows}[3] == ""
    one = sketch.fingerprints(spark.createDataFrame([(1, "a b c d e f g h")], "doc_id bigint, text string")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert sketch.fingerprints(empty).count() == 0


def test_op5_is_native(docs):
    plan = sketch.fingerprints(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# -- lines -------------------------------------------------------------------------------


def plain_removed(rows):
    kept, out = [], {}
    for k, t in sorted(rows.items()):
        for p, line in enumerate(t.split("\n")):
            s = set(re.split(r"[\x20\x09-\x0D]+", line.lower())) - {""}
            if s:
                if any(5 * min(len(s), len(o)) >= 4 * max(len(s), len(o)) and 9 * len(s & o) >= 4 * (len(s) + len(o)) for o in kept):
                    out.setdefault(k, []).append(p)
                kept.append(s)
    return out


def test_op6_matches_brute_force(docs, texts):
    found = {r.doc_id: r.removed for r in lines.decisions(docs).collect() if r.n_removed}
    assert found == plain_removed(texts)


def test_op6_matches_sql(docs):
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    want = {tuple(r) for r in con.execute(lines.SQL).fetchall()}
    assert {(r.doc_id, r.n_lines, r.n_removed, ",".join(map(str, r.removed))) for r in lines.decisions(docs).collect()} == want


def test_op6_first_round_is_for_crowded_buckets(spark):
    rows = [(k, 0, 20, 0, 0, level << 56 | 5) for level in (24, 25) for k in (level, 100 + level)]
    pairs, _ = lines.close_pairs(spark.createDataFrame(rows, "k bigint, pos int, n int, bits bigint, i int, token bigint"), 4)
    assert [tuple(r) for r in pairs.select("xk", "yk").collect()] == [(125, 25)]


def test_op6_white_space_and_case_are_brute_force(spark):
    texts = {1: "One  two\tthree ΟΔΟΣ\n \t \n\none two three οδος", 2: " three\x0btwo \x0cone\rΟΔΟΣ \n\r", 3: "a\u00a0b c\nC a\u00a0B  c\n  ", 4: "four five"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    found = {r.doc_id: (r.n_lines, r.removed) for r in lines.decisions(docs).collect()}
    assert {k: x for k, (_, x) in found.items() if x} == plain_removed(texts) == {1: [3], 2: [0], 3: [1]} and found[1][0] == 4
    sets = lines.line_rows(docs.select(docs.doc_id.alias("k"), docs.text.alias("t"))).select("line").collect()
    assert all(r.line == r.line.lower() and not set(r.line) & set("\t\x0b\x0c\r") for r in sets)


def test_op6_crowds_and_small_groups_are_brute_force(spark):
    rng = random.Random(5)
    crowd, few = [f"c{k}" for k in range(24)], [[f"f{g}x{k}" for k in range(15)] for g in range(30)]
    texts = {k: [" ".join(rng.sample(crowd, 21))] for k in range(200)}
    texts |= {200 + k: [" ".join(rng.sample(few[k % 30], rng.choice([12, 13, 14])))] for k in range(240)}
    seen, want = [], set()
    for k, (line,) in sorted(texts.items()):
        own = set(line.split())
        if any(9 * len(own & x) >= 4 * (len(own) + len(x)) for x in seen):
            want.add(k)
        seen.append(own)
    docs = spark.createDataFrame([(k, x[0]) for k, x in texts.items()], "doc_id bigint, text string")
    assert {r.doc_id for r in lines.decisions(docs).collect() if r.n_removed} == want and len(want) < 430


def test_op6_edges(edge, empty):
    rows = lines.decisions(edge).collect()
    found = {r.doc_id: (r.n_lines, r.removed) for r in rows}
    assert len(rows) == 11 and found[3] == (0, []) and found[4] == (1, []) and found[6] == (3, []) and found[None] == (1, [])
    assert found[1] == (1, []) and found[2] == (1, [0]) and found[7] == (4, [2, 3])
    assert lines.decisions(empty).count() == 0
    out = lines.deduplicated(edge)
    assert out.columns == edge.columns and out.count() == 11


def test_op6_is_native(docs):
    plan = lines.decisions(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_near_dedup_counts_shingles_of_all_documents(spark):
    """Shingles of 3 of 45,000 documents are listed with their number; a sample of them wouldn't show all."""
    import numpy as np
    from pyspark.sql import functions as F

    from tessellate.llm import simhash

    rows = spark.range(45_000).select(F.col("id").alias("k"), F.concat_ws(" ", *[F.concat(F.lit(f"{c}"), F.when(F.col("id") < 300, F.floor(F.col("id") / 3)).otherwise(F.col("id"))) for c in "abcde"]).alias("t"))
    hashes, n = simhash.common_shingles(rows, 5)
    want = sorted(int(simhash.shingle_hashes(" ".join(f"{c}{k}" for c in "abcde"), 5)[0]) >> 16 for k in range(100))
    assert hashes.tolist() == want and np.array_equal(n, np.full(100, 3))
