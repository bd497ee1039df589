"""Media, language ID, toxicity, quality, HTML extraction and the pipeline."""

import hashlib
import time
import itertools
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessellate.llm import html, langid, lines, media, quality, simhash, toxicity
from tessellate.llm.common import masked


def crc(k, n):
    return zlib.crc32(str(k).encode()) % n


# -- media -------------------------------------------------------------------------------


def test_op4_round_trip_and_facts(docs, texts):
    for r in media.document_media(docs).collect():
        data = texts[r.doc_id].encode()
        padded = data + b"\0" * (-len(data) % 64 if data else 64)
        assert (r.n_bytes, r.payload_bytes) == (len(data), len(padded))
        assert r.payload_sha256 == hashlib.sha256(padded).hexdigest() and r.tail_crc32 == zlib.crc32(padded[-64:])
        stored = media.to_png(padded)
        assert (r.media_bytes, r.media_sha256, r.feature) == (len(stored), hashlib.sha256(stored).hexdigest(), media.feature(padded))
        assert media.from_png(stored) == padded


def test_op4_edges(edge, empty):
    rows = media.document_media(edge).collect()
    assert len(rows) == 11
    by_id = {r.doc_id: r[1:] for r in rows}
    assert by_id[1] == by_id[2] and by_id[3] == by_id[4] and by_id[3][:2] == (0, 64)
    assert media.document_media(empty).count() == 0


def test_op4_sequences_keep_order_positions_and_captions(spark):
    page = '<p>one <b>two</b></p><figure><img src="media:aa" alt="x"><figcaption>cap</figcaption></figure>tail<img src="media:bb" alt="alt"><script>no</script>&amp;'
    rows = spark.createDataFrame([(1, page), (2, None), (3, "")], "page_id bigint, html string")
    found = {r.page_id: [(i.position, i.kind, i.text, i.digest, i.caption) for i in r["items"]] for r in media.sequences(rows).collect()}
    assert found[1] == [(0, "text", "one two", None, None), (1, "media", None, "aa", "cap"), (2, "text", "tail", None, None), (3, "media", None, "bb", "alt"), (4, "text", "&", None, None)]
    assert found[2] == found[3] == []
    facts = spark.createDataFrame([("aa", 5)], "digest string, n int")
    assert {(r.position, r.n) for r in media.resolve(media.references(media.sequences(rows)), facts).collect()} == {(1, 5), (3, None)}


def test_op4_captions_before_media_foreign_sources_and_lone_captions():
    page = '<figure><figcaption>cap</figcaption><img src="https://x.org/a.png"></figure><figure><figcaption>alone</figcaption></figure>end'
    found = [(i["position"], i["kind"], i["text"], i["source"], i["digest"], i["caption"]) for i in media.parse_sequence(page)]
    assert found == [(0, "media", None, "https://x.org/a.png", None, "cap"), (1, "text", "alone", None, None, None), (2, "text", "end", None, None, None)]


def test_op4_documents_are_interleaved(edge):
    rows = {r.doc_id: r["items"] for r in media.document_sequences(edge).collect()}
    assert [(i.kind, i.text, i.caption) for i in rows[7]] == [
        ("text", "Füße über Straßen", None), ("text", "the end", None), ("media", None, "46 bytes of text"), ("text", "the end", None), ("text", "The END", None),
    ]


def test_op4_broken_media_raise():
    good = media.to_png(b"\1" * 64)
    for bad in (b"", b"x" * 50, good[:20] + b"\xff" + good[21:]):
        with pytest.raises(ValueError):
            media.from_png(bad)


# -- language ID -------------------------------------------------------------------------


@pytest.mark.parametrize("block", [2, 3, 64])
def test_op7_viterbi_is_the_best_path(block, monkeypatch):
    monkeypatch.setattr(langid, "BLOCK", block)
    rng = np.random.default_rng(block)
    lengths = np.array([0, 1, 5, 6, 0, 4])
    scores = rng.normal(0, 2, (lengths.sum(), 3))
    found, at = langid.viterbi(scores, lengths, 1.5), 0
    value = lambda s, path: sum(s[t, x] for t, x in enumerate(path)) - 1.5 * sum(a != b for a, b in zip(path, path[1:]))
    for n in lengths:
        if n:
            s = scores[at : at + n]
            assert value(s, found[at : at + n]) == pytest.approx(max(value(s, p) for p in itertools.product(range(3), repeat=int(n))))
        at += n


def test_op7_held_out_accuracy_and_spans(spark, docs):
    rows = langid.identified(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (crc(r.doc_id, 4) == 2) for r in rows)
    assert np.mean([r.lang == r.lang_pred for r in rows if r.held_out]) > 0.95
    model = langid.model_of(docs)
    one = {r.lang: r.text for r in docs.filter("n_chars between 500 and 3000").select("lang", "text").collect()}
    mixed = " ".join(one["en"].split()[:60] + one["de"].split()[:60])
    spans = langid.labelled_spans(spark.createDataFrame([(1, mixed)], "doc_id bigint, text string"), model).collect()[0].spans
    assert [s.lang for s in spans] == ["en", "de"] and abs(spans[1].start - 60) <= 5


def test_op7_edges(edge, empty):
    rows = langid.identified(edge).collect()
    assert len(rows) == 11 and {r.doc_id: (r.lang_pred, r.score) for r in rows if r.doc_id in (3, 4, 6)} == dict.fromkeys((3, 4, 6), ("und", 0.0))
    assert not next(r for r in rows if r.doc_id is None).held_out
    assert langid.identified(empty).count() == 0


def fitted():
    words = {"en": "the house and water think", "de": "das haus und wasser denken", "zh": "我们喜欢喝水和看书今天天气很好", "th": "สวัสดีครับผมชอบอ่านหนังสือ"}
    return langid.Labeller(langid.fit([(k, t) for k, t in words.items() for _ in range(20)]))


def test_op7_reads_unspaced_text_to_its_end():
    zh, th = "我们喜欢喝水和看书今天天气很好" * 10, "สวัสดีครับผมชอบอ่านหนังสือ" * 60
    names, shares = fitted().predict([zh + th, zh + "thehouseandwater" * 200, zh])
    assert names == ["th", "en", "zh"] and 0.5 < shares[0] < 1 and 0.9 < shares[1] < 1 and shares[2] == 1
    assert [s["lang"] for s in fitted().spans([zh + th])[0]] == ["zh", "th"]
    assert fitted().spans(["the house " + zh])[0] == [{"start": 0, "end": 2, "lang": "en"}, {"start": 2, "end": 3, "lang": "zh"}]


def test_op7_a_script_never_learned_has_no_language(spark):
    names, shares = fitted().predict(["мы читаем книги дома", "the house мы читаем книги дома", "12 34"])
    assert names == ["und", "en", "und"] and shares[0] == shares[2] == 0 and 0.2 < shares[1] < 0.5
    docs = spark.createDataFrame([(k, "the house and water", "en") for k in range(20)] + [(99, "мы читаем книги", None)], "doc_id bigint, text string, lang string")
    assert sorted(r[0] for r in langid.in_one_language(docs).select("doc_id").collect()) == list(range(20))


# -- toxicity and quality ----------------------------------------------------------------


def labelled(spark, good, bad, n, column):
    rng = np.random.default_rng(3)
    words = [f"w{k}" for k in range(300)]
    texts = [(k, " ".join([*rng.choice(words, 40), *((bad,) if k % 3 == 0 else (good,))])) for k in range(n)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    return docs, spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(n)], f"doc_id bigint, {column} int")


def test_op8_learns_and_holds_out(spark):
    docs, labels = labelled(spark, "kind words", "Awful! person", 600, "toxic")
    rows = toxicity.toxic(docs, labels).collect()
    assert all(r.held_out == (crc(r.doc_id, 5) == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert np.mean([r.predicted == (r.doc_id % 3 == 0) for r in rows if r.held_out]) > 0.97
    assert len(toxicity.fit([], {})["at"]) == 0


def test_op8_ftrl_is_sparse_and_follows_its_update():
    m = toxicity.FTRL(bits=4, alpha=0.5, l1=0.0, l2=0.0)
    m.learn(np.array([3]), 1)
    g, w = -0.5, 0.0  # p is 1/2 before the first update
    assert m.z[3] == g - (abs(g) / 0.5) * w and m.n[3] == 0.25
    assert m.weights(np.array([3]))[0] == pytest.approx(0.5 / ((1 + 0.5) / 0.5))
    assert toxicity.FTRL(bits=4, l1=9.0).weights(np.arange(4)).tolist() == [0.0] * 4


def test_op8_ftrl_is_the_plain_algorithm():
    """Against the update written out by coordinate, in plain dictionaries."""
    rng, m = np.random.default_rng(5), toxicity.FTRL(bits=6, alpha=0.3, beta=0.5, l1=0.2, l2=0.1)
    z, n, last = {}, {}, 1 << 6

    def weight(i):
        l1 = 0.0 if i == last else 0.2
        if abs(z.get(i, 0.0)) <= l1:
            return 0.0
        return -(z[i] - (l1 if z[i] > 0 else -l1)) / ((0.5 + n[i] ** 0.5) / 0.3 + 0.1)

    for _ in range(300):
        at, y = np.unique(rng.integers(0, 64, 5)), int(rng.integers(0, 2))
        m.learn(at, y)
        mine = [*at.tolist(), last]
        before = {i: weight(i) for i in mine}
        g = 1 / (1 + np.exp(-sum(before.values()))) - y
        for i in mine:
            was = n.get(i, 0.0)
            n[i] = was + g * g
            z[i] = z.get(i, 0.0) + g - (n[i] ** 0.5 - was**0.5) / 0.3 * before[i]
    assert m.weights(np.arange(65)) == pytest.approx([weight(i) for i in range(65)])


def test_op8_edges(edge, empty, spark):
    labels = spark.createDataFrame([(1, 1), (1, 0), (7, 0), (None, 1), (9, None)], "doc_id bigint, toxic int")
    rows = toxicity.toxic(edge, labels).collect()
    assert len(rows) == 11 and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.toxic(empty, labels).count() == 0


def test_op9_separates_the_test_grades(docs, sf, spark):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = quality.selected(docs, labels).join(labels, "doc_id").collect()
    assert np.mean([r.keep == (r.quality == 1) for r in rows]) > 0.95


def test_op9_grades_of_documents_not_learned_from(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{name}.parquet") for name in ("documents", "labels"))
    fold = F.crc32(F.col("k").cast("string").cast("binary")) % 4 == 0
    model = quality.model_of(docs, labels, taken=~fold)
    rows = quality.graded(docs, model).withColumnRenamed("doc_id", "k").filter(fold).join(labels.withColumnRenamed("doc_id", "k"), "k").collect()
    # 0.93 with some 300 documents to learn from; see the README for larger tables
    assert len(rows) > 50 and np.mean([(r.tail_probability >= 0.5) == (r.quality == 1) for r in rows]) > 0.9


@pytest.mark.parametrize("y", [0, 1, 2])
def test_op9_slopes_are_those_of_the_likelihood(y):
    def loss(score, t):
        p = np.r_[1.0, 1 / (1 + np.exp(t - score)), 0.0]
        return -np.log(p[y] - p[y + 1])

    t, h = np.array([-0.4, 0.9]), 1e-6
    by_score, by_t = quality.slopes(0.3, t, y)
    assert by_score == pytest.approx((loss(0.3 + h, t) - loss(0.3 - h, t)) / (2 * h), abs=1e-6)
    assert by_t == pytest.approx([(loss(0.3, t + h * e) - loss(0.3, t - h * e)) / (2 * h) for e in np.eye(2)], abs=1e-6)


def test_op9_three_ordered_grades():
    rng = np.random.default_rng(0)
    rows = [(g, " ".join(rng.choice([f"g{g}w{k}" for k in range(20)] + ["x", "y"], 30))) for g in (0, 1, 2) for _ in range(80)]
    model = quality.fit(rows, {0: 80, 1: 80, 2: 80})
    assert model["grades"] == [0, 1, 2] and model["t"][0] <= model["t"][1]
    features = quality.Features()
    mean = [np.mean([quality.tails(model, *features.of(t)).sum() for g, t in rows if g == want]) for want in (0, 1, 2)]
    assert mean[0] < 0.5 < mean[1] < 1.5 < mean[2]


def test_op9_edges(edge, empty, spark):
    labels = spark.createDataFrame([(1, 1), (7, 0), (None, 1), (9, None)], "doc_id bigint, quality int")
    assert quality.selected(edge, labels).count() == 11
    assert quality.selected(empty, labels).count() == 0
    assert quality.selected(edge, labels.limit(0)).filter("keep").count() == 11


# -- HTML --------------------------------------------------------------------------------


def page(title, body, extra=""):
    return f"<html><head><title>{title}</title><script>var a='</p>';</script></head><body><nav><a href=/>menu</a></nav>{extra}{body}<footer>foot</footer>"


def test_op10_keeps_the_article(spark):
    article = '<article><h1>T {0}</h1><p>one &amp; {0}<br>two<p>three<ul><li>a<li>b</ul><div class="ad box">buy</div><div class="promo2"><p>Sign up</p></div><table><tr><td>x</td><td>y</td></tr></table></article><div id=comments><p>reader</p></div>'
    rows = [(k, f"http://h.org/{k}", page(f"t{k}", article.format(k))) for k in range(30)] + [(90, None, None), (91, "bad:url[", ""), (92, "http://h.org/copy", page("t1", article.format(1)))]
    found = {r.page_id: r for r in html.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    want = lambda k: f"T {k}\n\none & {k} two\n\nthree\n\na\n\nb\n\nx\n\ny"
    assert {k: r.text for k, r in found.items() if k < 90} == {k: want(k) for k in range(30)}
    assert found[92].text == want(1) and found[92].n_chars == len(want(1))
    assert found[90].text == found[91].text == "" and found[90].n_chars == 0


def test_op10_templates_without_article(spark):
    rows = [(k, "http://x.org/", f"<title>{k}</title><body><div><p>same box</p></div><div><p>own text {k}</p><p>shared sentence</p></div>") for k in range(10)]
    found = html.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    assert {r.text for r in found} == {f"own text {k}\n\nshared sentence" for k in range(10)}


def test_op10_all_test_pages_give_their_document(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    whole = {" ".join(r.text.split()) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()}
    found = html.main_text(pages).collect()
    assert len(found) == pages.count()
    assert all(" ".join(r.text.split("\n\n", 1)[1].split()) in whole for r in found)


def test_op10_keeps_text_outside_articles(spark):
    teaser = "<article><h3>Teaser {0}</h3></article>"
    lead = "<main><h1>Head {0}</h1><p>lead {0}</p><article><p>body {0}</p></article></main>"
    rows = [(k, "http://a.org/", f"<title>{k}</title><main><div><p>long body {k}</p></div></main>" + teaser.format(k)) for k in range(5)]
    rows += [(10 + k, "http://b.org/", f"<title>{k}</title>" + lead.format(k) + "<div><p>box</p></div>") for k in range(5)]
    found = {r.page_id: r.text for r in html.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert found == {k: f"long body {k}\n\nTeaser {k}" for k in range(5)} | {10 + k: f"Head {k}\n\nlead {k}\n\nbody {k}" for k in range(5)}


def test_op10_templates_do_not_depend_on_the_hosts_size(spark):
    boxed = lambda k: "<div><p>section box</p></div>" if k < 4 else ""
    rows = [(k, "http://a.org/", f"<title>t{k}</title><body>{boxed(k)}<div><p>own {k}</p></div>") for k in range(200)]
    rows += [(1000 + k, "http://b.org/", f"<title>t{k}</title><header><h1>Site</h1></header><div><p>box</p></div><div><p>own {k}</p></div>") for k in range(5)]
    found = html.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    assert {r.page_id: r.text for r in found} == {k: f"own {k % 1000}" for k, _, _ in rows}


def test_op10_edges(spark):
    odd = [(1, "u", "<"), (2, "u", "<p>a</div></p></b>c"), (3, "u", "<div>" * 3000 + "deep" + "</div>" * 3000), (None, "u", "<!-- x --><p>ok</p>"), (1, "u", "<")]
    found = html.main_text(spark.createDataFrame(odd, "page_id bigint, url string, html string"))
    assert found.count() == 5
    assert html.main_text(spark.createDataFrame([], "page_id bigint, url string, html string, URL string")).count() == 0


# -- pipeline ----------------------------------------------------------------------------


def test_masked_keeps_all_columns(edge):
    out = masked(edge, "text", lambda: lambda texts: [len(t) > 100 for t in texts])
    assert out.columns == edge.columns and sorted(r[0] for r in out.collect()) == [5, 9]


def test_masked_works_on_slices_of_a_batch(spark):
    docs = spark.createDataFrame([(k, f"{k % 2} " + "word " * 4000) for k in range(100)], "doc_id bigint, text string").coalesce(1)

    def decide(texts):
        assert sum(map(len, texts)) <= 1 << 18, "more texts at once than a slice has"
        return [t.startswith("1") for t in texts]

    assert sorted(r[0] for r in masked(docs, "text", lambda: decide).select("doc_id").collect()) == list(range(1, 100, 2))


def test_pipeline_stages(spark, docs, sf):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "quality_classifier", "line_dedup", "near_dedup", "best_fit_packing"]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, now = now, stage(spark, now, sf)
        assert now.columns == docs.columns
        kept = {r.doc_id for r in now.select("doc_id").collect()}
        if name == "quality_classifier":
            assert all((k in kept) == (q == 1) for k, q in labels.items() if k in {r.doc_id for r in before.select("doc_id").collect()})
    rows = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in rows} == kept


def test_pipeline_runs_on_an_empty_table(spark, docs, sf):
    now = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, sf)
    assert now.count() == 0


def blocks_of(page):
    return [b for b, _ in html.parse(page)[0] if b is not None]


def test_op10_names_forms_hidden_parts_and_leads():
    page = (
        '<article><header><h1>Title</h1><p>Lead.</p><div>by line</div></header><section id="related-work"><p>Work.</p></section><div class="related-posts"><p>gone</p></div>'
        '<p>One <span style="display: none">hid<span>den</span></span>two <span hidden>x</span>three <math>a</math>.</p><form><p>ask</p></form></article>'
    )
    assert blocks_of(page) == ["Title", "Lead.", "Work.", "One two three", "a", "."] or blocks_of(page) == ["Title", "Lead.", "Work.", "One two three a."]
    assert blocks_of("<body><form><h1>All</h1><p>of the page</p></form><p>x</p></body>") == ["All", "of the page", "x"]


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<p>Price was <del>10</del> <ins>12</ins> today</p>", ["Price was 10 12 today"]),
        ("<p>Story costs <font>only</font> ten, <ruby>ka<rt>fi</rt></ruby>.</p>", ["Story costs only ten, kafi."]),
        ("<article><header><div><h1>Title</h1><p>Lead</p></div><div>by line</div></header><p>Text.</p></article>", ["Title", "Lead", "Text."]),
        ("<article><header><hgroup><h1>Title</h1><h2>Below</h2></hgroup></header><p>Text.</p></article>", ["Title", "Below", "Text."]),
        ("<main><header><h1>Title</h1></header><p>Text.</p></main>", ["Title", "Text."]),
        ('<article><section id="notice"><p>Section.</p></section><p class="alert">A.</p><p class="banner">B.</p><p class="reply">C.</p></article>', ["Section.", "A.", "B.", "C."]),
        ('<table><tr class="header"><td>Year</td></tr><tr><td>1900</td></tr></table>', ["Year", "1900"]),
        ('<nav><ul><li><a href="/a">a</a></ul><article><p>Text.</p></article>', ["Text."]),
        ('<nav><a href="/a">a</a><p>Text.</p><div class="ad"><p>buy</p></div><p>More.</p>', ["Text.", "More."]),
        ('<nav><p>Menu</p></nav><p>Text.</p><p class="ad">buy<p>More.', ["Text.", "More."]),
        ('<article><p>Text.</p><section class="discussion"><p>first!</p></section><div class="user-comments"><p>second</p></div><section id="comments"><p>third</p></section></article>', ["Text."]),
    ],
)
def test_op10_blocks(page, want):
    assert blocks_of(page) == want


def test_op10_counts_come_before_names(spark):
    """Menus, adverts and text boxes that recur are templates; what has its own words each time goes by its name."""
    shared = "<nav><ul><li>home</ul></nav><div class=ad>Buy one.</div>"
    rows = [(k, "http://a.org/", f"<title>t{k}</title><body>{shared}<div><p>box</p></div><article><h1>t{k}</h1><p>Own {k}.</p></article><footer>page {k}</footer>") for k in range(5)]
    rows += [(5, "http://b.org/", rows[0][2])]
    store = html.parsed(spark.createDataFrame(rows, "page_id bigint, url string, html string"))
    found = {(r.host, r.n_kept, r.n_template, r.n_named) for r in html.reasons(store).collect()}
    assert found == {("a.org", 2, 3, 1), ("b.org", 3, 0, 3)}
    assert html.reasons(store.limit(0)).count() == 0


def test_op10_deep_pages_take_linear_time():
    start = time.time()
    assert blocks_of("<div>" * 16_000 + "text" + "</div>" * 16_000) == ["text"]
    assert time.time() - start < 10


# -- the pipeline's stages ---------------------------------------------------------------


def test_pipeline_stages_on_edges(edge, empty, spark):
    labels = spark.createDataFrame([(1, 1), (7, 0), (None, 1), (9, None)], "doc_id bigint, quality int")
    stages = [langid.in_one_language, lambda d: quality.of_quality(d, labels), lines.deduplicated, simhash.one_of_each]
    for stage in stages:
        out = stage(edge)
        rows = [tuple(r) for r in out.collect()]
        assert out.columns == edge.columns and 0 < len(rows) <= 11
        assert stage(empty).count() == 0
    kept = [r[0] for r in simhash.one_of_each(edge).collect()]
    # 2 repeats 1; the three without words are one group; both rows of 7 are one document; a null id stays
    assert sorted(k for k in kept if k is not None) == [1, 3, 5, 7, 7, 8, 9] and None in kept


def test_op10_template_counts_are_a_plain_count(spark):
    """A site without article elements: what the counts remove is what a plain count over pages removes."""
    box = "<div class=frame><div><p>Members read more here.</p></div></div>"
    rare = "<div class=frame><div><p>Only twice.</p></div></div>"
    pages = []
    for k in range(12):
        body = f"<div class=w><h1>T{k}</h1><p>Own text {k}.</p>{box if k != 5 else ''}{rare if k in (3, 4) else ''}</div>"
        pages.append((k, f"http://{'a' if k < 9 else 'b'}.org/{k}", f"<html><head><title>T{k}</title></head><body>{body}</body></html>"))
    rows = html.main_text(spark.createDataFrame(pages, "page_id bigint, url string, html string")).collect()
    found = {r.page_id: r.text for r in rows}
    titles: dict[tuple[str, str], set[int]] = {}
    for k, url, page_ in pages:
        for part in (box, rare):
            if part in page_:
                titles.setdefault((url[7], part), set()).add(k)
    for k, url, page_ in pages:
        left = [x for part, x in ((box, "Members read more here."), (rare, "Only twice.")) if part in page_ and len(titles[url[7], part]) < 3]
        assert found[k] == "\n\n".join([f"T{k}", f"Own text {k}.", *left])
