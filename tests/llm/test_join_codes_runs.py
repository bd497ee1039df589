"""The n-gram join (11), vector codes (12) and periodic runs (13) against plain versions, SQL and odd rows."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest

from tessellate.llm import ngram_join, periodic, queries, vectors


def sql(sf, query, tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con.execute(query)


def same_as_sql(found, want):
    names = [d[0] for d in want.description]
    assert sorted(map(tuple, found.select(*names).collect()), key=str) == sorted(want.fetchall(), key=str)


# -- 11 --------------------------------------------------------------------------------


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def plain_components(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, x in enumerate(sets):
        for j in range(i):
            both = len(x & sets[j])
            if x and sets[j] and 100 * both >= 80 * (len(x) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted([(i, len(s), least.get(find(k))) for k, ((i, _), s) in enumerate(zip(rows, sets, strict=True))], key=str)


def joined(spark, rows, **options):
    found = ngram_join.joined(spark.createDataFrame(rows, "doc_id bigint, text string"), **options)
    return sorted(map(tuple, found.collect()), key=str)


def near_copies(rng):
    """Chains of texts at and around the threshold, passages that many share, short texts, repeated words."""
    words = [f"w{k}" for k in range(400)]
    passage = rng.choices(words, k=60)
    rows = []
    for group in range(12):
        base = rng.choices(words, k=rng.choice([6, 20, 70, 200]))
        for _ in range(rng.randint(1, 9)):
            own = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 25))):
                own[rng.randrange(len(own))] = rng.choice(words)
            rows.append(own + (passage if group % 3 == 0 else []))
            base = own if rng.random() < 0.5 else base
    rows += [passage, passage + ["more"], ["a"] * 50, ["a"] * 51, ["a"] * 7 + ["b"], ["x", "y"], ["X", "y"], ["x", "z"]]
    rng.shuffle(rows)
    return [(k, " ".join(w)) for k, w in enumerate(rows)]


def test_join_is_brute_force(spark):
    rows = near_copies(random.Random(1))
    assert joined(spark, rows) == plain_components(rows)


def test_join_with_popular_shingles_in_fragments_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "SELDOM", 1)
    rows = near_copies(random.Random(3))
    assert joined(spark, rows, fragments=3) == plain_components(rows)


def test_join_loses_no_link_as_centres_leave(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "MEETINGS", 0)  # rounds with centres, however few meetings are left
    rows = near_copies(random.Random(4))
    assert joined(spark, rows) == plain_components(rows)


def test_join_compares_few_meetings_at_once(spark, monkeypatch):
    made, plain = [], ngram_join.written
    monkeypatch.setattr(ngram_join, "written", lambda df, name, *more, **options: made.append(name) or plain(df, name, *more, **options))
    rows = [(k, " ".join(f"{c}{k // 2}" for c in "abcdefghijklmn"[: 12 + k % 2])) for k in range(8)] + [(9, "a0 b0 c0 d0 e0 " + "x y z u v w " * 2)]
    assert joined(spark, rows) == plain_components(rows) and made.count("open") == 1


def test_join_odd_rows(spark, edge, empty):
    found = sorted(map(tuple, ngram_join.joined(edge).collect()), key=str)
    assert found == plain_components([(r[0], r[1]) for r in edge.collect()])
    assert ngram_join.joined(empty).collect() == [] and ngram_join.joined(empty).columns == ["doc_id", "n_shingles", "component_id"]
    assert joined(spark, [(None, "a b c d e f"), (None, "A b c d e f"), (None, "")]) == sorted([(None, 2, None)] * 2 + [(None, 0, None)], key=str)


def test_join_is_its_sql(spark, sf):
    same_as_sql(queries.op11_ngram_join(spark, sf), sql(sf, ngram_join.SQL, ["documents"]))


def test_hashes_are_of_words_not_of_their_joins():
    of = ngram_join.Shingles().of
    assert len(np.intersect1d(of("ab c d e f"), of("a bc d e f"))) == 0 and len(of("a b c d")) == 1 and len(of("\x0b \t")) == 0
    assert len(np.intersect1d(of("a a a a"), of("a a a a a"))) == 0 and (of("Ä É") != of("ä é")).all()


# -- 12 --------------------------------------------------------------------------------


def plain_codes(rows, parts=4, entries=256, rounds=4):
    kept = sorted((i, [int(np.floor(1024 * float(x))) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and np.isfinite(x) for x in v))
    size = len(kept[0][1]) // parts
    cut = [[v[p * size : (p + 1) * size] for p in range(parts)] for _, v, _ in kept]
    books = [[list(c[p]) for c in cut[:entries]] for p in range(parts)]
    nearest = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            of = {}
            for c in cut:
                of.setdefault(nearest(c[p], books[p])[1], []).append(c[p])
            for k, own in of.items():
                books[p][k] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    found = [[nearest(c[p], books[p]) for p in range(parts)] for c in cut]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    errors = [sum(d for d, _ in f) for f in found]
    of_label = {}
    for (_, _, label), e in zip(kept, errors, strict=True):
        of_label[label] = of_label.get(label, 0) + e
    return sorted(((i, "".join(f"{k:02x}" for _, k in f), e, of_label[label], digest) for (i, _, label), f, e in zip(kept, found, errors, strict=True)), key=str)


def coded(spark, rows, **options):
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    return sorted(map(tuple, vectors.coded(table, **options).collect()), key=str)


def test_codes_are_plain_lloyd_with_ties(spark):
    rng = np.random.default_rng(5)
    coarse = [(int(i), [float(x) / 4 for x in rng.integers(-3, 4, 8)], [None, 1, 2][i % 3]) for i in range(150)]
    for entries in (40, 256):
        assert coded(spark, coarse, entries=entries) == plain_codes(coarse, entries=entries)
    fine = [(int(i), rng.normal(0, 1 + i % 3, 12).astype(np.float32).tolist(), 1) for i in range(200)]
    assert coded(spark, fine, entries=30) == plain_codes(fine, entries=30)


def test_codes_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(5, [1.0, 2.0, -0.0001, 4.0], 1), (2, None, 1), (3, [1.0, None, 1.0, 1.0], 1), (4, [nan, 0.0, 0.0, 0.0], 1), (6, [0.0, 0.0, inf, 0.0], None), (7, [1.0, 2.0, 3.0, 4.5], None), (7, [1.0, 2.0, 3.0, 4.5], None), (9, [1.0, 2.0, 3.0, 4.5], 1)]
    assert coded(spark, rows) == plain_codes(rows)
    assert coded(spark, []) == [] == coded(spark, [(1, None, 1), (2, [], 1), (3, [1.0], 1)])
    table = spark.createDataFrame([(None, [1.0] * 4, 1, 7), (1, [2.0] * 4, 1, 7), (2, [2.0] * 8, 1, 7)], "vec_id bigint, embedding array<double>, label int, LABEL int")
    assert sorted((r.vec_id, r.code) for r in vectors.coded(table).collect() if r.vec_id) == [(1, "00000000")] and vectors.coded(table).count() == 2
    with pytest.raises(Exception, match="too large"):
        coded(spark, [(1, [1e30, 0.0, 0.0, 0.0], 1)])


def test_codes_are_their_sql(spark, sf):
    same_as_sql(queries.op12_vector_codes(spark, sf), sql(sf, vectors.SQL, ["embeddings"]))


def test_bounds_hold_and_spare_work():
    """After moves, bounds stay below the distances to a group's other entries, and most entries aren't scanned."""
    rng = np.random.default_rng(2)
    centres = rng.integers(-900, 900, (256, 16))
    x = centres[rng.integers(0, 256, 3000)] + rng.integers(-40, 40, (3000, 16))
    groups = vectors.grouped_entries(centres)
    t = groups.max() + 1
    code, distance, bounds, looked = vectors.assigned(x, centres, groups, np.zeros(3000, np.int64), np.zeros((3000, t)))
    assert looked == 3000 * 256
    for step in range(3):
        moved = centres + rng.integers(-2, 3, centres.shape)
        drift = np.sqrt(((moved - centres) ** 2).sum(1)) * (1 + 1e-9)
        bounds = np.maximum(vectors._unpacked(vectors._packed(bounds)) - np.array([drift[groups == g].max() for g in range(t)]), 0)
        code, distance, bounds, looked = vectors.assigned(x, moved, groups, code, bounds)
        every = ((x[:, None] - moved[None]) ** 2).sum(2).astype(float)
        assert (code == every.argmin(1)).all() and (distance == every.min(1)).all() and looked < 3000 * 256 / 4
        every[np.arange(3000), code] = np.inf
        assert all((bounds[:, g] ** 2 <= every[:, groups == g].min(1) * (1 + 1e-9)).all() for g in range(t))
        centres = moved


# -- 13 --------------------------------------------------------------------------------


def plain_runs(words, least=6, times=4):
    found = {}
    for q in range(1, len(words) // times + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, times * q):
                found.setdefault((i, j - i + q), q)
            i = max(i, j) + 1
    return sorted((s, q, n) for (s, n), q in found.items())


def plain_digest(doc_id, text):
    words = (text or "").encode().split()
    if doc_id is not None and (h := zlib.crc32(str(doc_id).encode())) % 10 == 0 and words:
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    gone = {k for s, q, n in runs for k in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[2] / r[1], r[0], r[1]), default=None)
    shown = (best[0], best[2], best[1], 1000 * best[2] // best[1]) if best else (None,) * 4
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (doc_id, len(runs), *shown, sha("".join(f"{s},{n},{q}\n" for s, q, n in runs).encode()), sha(b" ".join(w for k, w in enumerate(words) if k not in gone)))


def test_runs_are_brute_force():
    rng = random.Random(1)
    texts = []
    for _ in range(1500):
        n, k = rng.randint(0, 60), rng.choice([1, 2, 2, 3, 5])
        words = [b"abcde"[c : c + 1] for c in rng.choices(range(k), k=n)]
        if n > 4 and rng.random() < 0.5:
            a = rng.randrange(n)
            p = 1 + (n - a) // rng.randint(3, 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        texts.append(words)
    for least, times in ((6, 4), (2, 2), (9, 3)):
        found = periodic.runs_in(texts, least, times)
        assert [sorted((s, q, n) for s, n, q in r.tolist()) for r in found] == [plain_runs(t, least, times) for t in texts]
    fibonacci = ["a", "ab"]
    while len(fibonacci[-1]) < 1500:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    word = [c.encode() for c in fibonacci[-1]]
    assert [(s, q, n) for s, n, q in periodic.runs_in([word], 2, 2)[0].tolist()] == plain_runs(word, 2, 2)


def test_runs_of_documents(spark, sf, docs, edge, empty):
    found = periodic.digests(periodic.planted(docs)).collect()
    assert sorted(map(tuple, found)) == sorted(plain_digest(r.doc_id, r.text) for r in docs.collect()) and sum(r.n_runs > 0 for r in found) > 10
    odd = sorted(map(tuple, periodic.digests(periodic.planted(edge)).collect()), key=str)
    assert odd == sorted((plain_digest(r[0], r[1]) for r in edge.collect()), key=str)
    assert periodic.digests(periodic.planted(empty)).collect() == []


def test_runs_and_collapsed_text(spark):
    table = spark.createDataFrame([(1, "no " * 3 + "ha " * 9 + "\n so it goes so it goes so it goes so it goes on"), (2, None), (3, " \n")], "doc_id bigint, text string")
    rows = {r.doc_id: r for r in periodic.with_runs(table).collect()}
    assert [tuple(x) for x in rows[1].runs] == [(3, 9, 1), (12, 12, 3)] and rows[1].collapsed == "no no no ha so it goes on"
    assert rows[2].runs == rows[3].runs == [] and rows[2].collapsed == rows[3].collapsed == ""
