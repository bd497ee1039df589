"""The DataFrame operators against the kernels, sources and sinks, whole plans, streams, and all SQL."""

import datetime
import difflib
import json
import re
import sys
from collections import Counter

import duckdb
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

import __spark_entry__
from tessellate.functions import alignment, formats, kernels, text
from tessellate.functions.formats import Example, Extraction, Template
from tessellate.operators import documents, extraction, inference, review
from tessellate.plans import extract as plan
from tessellate.plans import queries
from tessellate.sources import documents as sources
from tessellate.streaming import extract as streaming
from tessellate.types import InvalidDatasetError, InvalidDocumentError

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import tests
ODD = ["", "\n", "Ebb, flow!", "Depth: 9\nDraught=4m.", "İSTANBUL ΑΣ été 日本語 😀😀!! __ a_b", "Dr. No. said \"hi.\" \n ok\r\nNext (one.) 'x'\nlower", "a  \n b", "١٢٣ ½ x²"]


def table(spark, texts):
    return spark.createDataFrame([(str(k), t) for k, t in enumerate(texts)], "document_id string, text string")


@pytest.fixture(scope="module")
def texts(spark, sf):
    return ODD + [r[0] for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]


def test_t1_t2_t3_native_tokens_are_the_kernels(spark, texts):
    rows = documents.token_rows(table(spark, texts)).orderBy("index").collect()
    found = {}
    for r in rows:
        found.setdefault(r.document_id, []).append((r.token_type, r.start_pos, r.end_pos, r.first_token_after_newline))
    assert found == {str(k): t for k, x in enumerate(texts) if (t := kernels.regex_tokens(x))}


def test_t4_tokenized_column(spark):
    rows = documents.tokenized(table(spark, ODD), "unicode").collect()
    assert all([(t.token_type, t.start_pos, t.end_pos, t.first_token_after_newline) for t in r.tokens] == kernels.unicode_tokens(r.text) for r in rows)


def test_t8_t9_t10_native_sentences_are_the_kernels(spark, texts):
    found = {}
    for r in documents.sentence_rows(table(spark, texts)).orderBy("sentence_index").collect():
        found.setdefault(r.document_id, []).append((r.token_start, r.token_end))
    assert found == {str(k): s for k, x in enumerate(texts) if (s := list(kernels.sentences(x, kernels.regex_tokens(x))))}


def test_c1_c3_c9_chunks(spark, texts):
    rows = documents.chunked(table(spark, texts), 300).collect()
    assert all(texts[int(r.document_id)][r.char_start : r.char_end] == r.chunk_text for r in rows)
    assert {r.document_id for r in rows} == {str(k) for k, x in enumerate(texts) if kernels.regex_tokens(x)}


def test_c4_sanitized(spark):
    rows = table(spark, ["  a \n\t b　c ", " \n", None]).select(text.sanitized(F.col("text"))).collect()
    assert [r[0] for r in rows] == ["a b c", None, None]


def test_c5_c6_c8_ids_and_context(spark):
    docs = spark.createDataFrame([("a", "x", None), ("b", "y", "own"), ("a", "z", None)], "document_id string, text string, additional_context string")
    with pytest.raises(InvalidDocumentError):
        sources.require_unique_ids(docs)
    assert sources.require_unique_ids(docs.filter("text <> 'z'")).count() == 2
    assert sorted(r.additional_context for r in sources.from_table(docs, "document_id", "text", "given").collect()) == ["given", "given", "own"]


def test_c7_batches(spark):
    rows = spark.range(25).select(F.col("id").cast("string").alias("document_id"), F.lit(0).alias("chunk_index"))
    sizes = [r[1] for r in documents.batched(rows, 4, groups=2).groupBy("batch_id").count().collect()]
    assert sum(sizes) == 25 and max(sizes) == 4 and sum(s < 4 for s in sizes) <= 2
    assert list(map(len, documents.batches(iter(range(7)), 3))) == [3, 3, 1]


def test_p5_previous_chunk_goes_with_the_prompt(spark):
    docs = spark.createDataFrame([("d", "Dr. Ines Marlow is a harbour pilot. She works on the outer sea lanes.", "")], "document_id string, text string, additional_context string")
    rows = documents.with_previous(documents.chunked(docs, 40), 30).orderBy("chunk_index").collect()
    assert [r.context for r in rows] == [None, "[Previous text]: ...nes Marlow is a harbour pilot."]
    template, fmt = Template("D", [Example("t", [Extraction("c", "t")])]), inference.format_for(inference.Rules({}))
    made = extraction.prompted(spark.createDataFrame([("q", "ctx"), ("r", None)], "chunk_text string, context string"), template, fmt).collect()
    assert [r.prompt for r in made] == [template.render(fmt, "q", "ctx"), template.render(fmt, "r")]


def spec(outputs=None, other=None, **options):
    return plan.Spec(Template("D"), inference.Replay(outputs or {}, other), fences=False, **options)


def wrapped(*items):
    return json.dumps({"extractions": list(items)})


def test_i1_too_few_answers_raise(spark):
    short = inference.Replay({"a": "", "b": ""})
    short.infer = lambda prompts, **settings: []
    with pytest.raises(Exception, match="answers"):
        inference.infer(table(spark, ["a", "b"]).select(F.col("text").alias("prompt")), short).collect()


def test_i1_r4_a10_m4_whole_plan(spark):
    docs = table(spark, ["Pilot boards tonight at dusk.", "Pilot boards tonight at dusk.", "", "calm"])
    answer = wrapped({"WHO": "Pilot", "WHO_attributes": {"k": "v"}}, {"WHEN": "dusk"})
    made = plan.extract(docs, spec(other=lambda p: answer if "dusk" in p else "broken", batch_length=1)).orderBy("document_id").collect()
    assert [r.document_id for r in made] == ["0", "1", "2", "3"] and [len(r.extractions) for r in made] == [2, 2, 0, 0]
    a, b = made[1].extractions
    assert (a.extraction_class, tuple(a.char_interval), a.alignment_status, json.loads(a.attributes)) == ("WHO", (0, 5), "match_exact", {"k": "v"}) and tuple(b.char_interval) == (24, 28)
    with pytest.raises(Exception, match="JSON"):
        plan.resolved(docs, spec(other=lambda p: "broken", suppress_parse_errors=False)).collect()
    blank = wrapped({"a": " "})
    errors = plan.resolved(docs, spec(other=lambda p: blank if "dusk" in p else "broken")).select("result.parse_error", "result.align_error").collect()
    assert sum(r.parse_error is not None for r in errors) == 1 and sum(r.align_error is not None for r in errors) == 2


def test_m2_m3_later_passes_add_what_does_not_overlap(spark):
    one, two = wrapped({"boat": "tug Alma"}), wrapped({"name": "Alma"}, {"cargo": "salt"}, {"goods": "salt"}, {"x": "unplaced"})
    rows = table(spark, ["The tug Alma carries salt and rope."])
    prompts = plan.prompts(rows, spec(passes=2))
    answers = prompts.withColumn("outputs", F.array(F.struct(F.lit(1.0).alias("score"), F.when(F.col("pass") == 0, one).otherwise(two).alias("output"))))
    found = extraction.extraction_rows(extraction.resolved(answers, spec().format()))
    got = extraction.assembled(rows, found).collect()[0].extractions
    assert [e.extraction_class for e in got] == ["boat", "cargo", "x"]


def test_s3_s4_csv(spark, tmp_path):
    path = tmp_path / "d.csv"
    path.write_text('id,note,more\n1,"a, ""b""\nc",x\n2,,y\n')
    assert [tuple(r)[:2] for r in sources.read_csv(spark, str(path), "id", "note").collect()] == [("1", 'a, "b"\nc'), ("2", "")]
    with pytest.raises(InvalidDatasetError):
        sources.read_csv(spark, str(path), "id", "absent")
    with pytest.raises(NotImplementedError):
        sources.read_csv(spark, "d.txt", "id", "note")


def test_s5_s6_k1_k2_jsonl(spark, tmp_path):
    made = plan.extract(table(spark, ["Ann é  lives.", ""]), spec(other=lambda p: wrapped({"n": "Ann"}, {"gone": "zzz"})))
    sources.write_jsonl(made, str(tmp_path / "out"), single_file=True)
    assert sorted(map(str, sources.read_jsonl(spark, str(tmp_path / "out")).collect())) == sorted(map(str, made.collect()))
    (line,) = [x for p in (tmp_path / "out").glob("part-*") for x in p.read_text().split("\n") if "Ann" in x]
    parsed = json.loads(line)
    assert list(parsed) == ["extractions", "text", "document_id"] and parsed["extractions"][1]["char_interval"] is None and "token_interval" not in parsed["extractions"][0]
    assert "Ann" in review.visualized_file(spark, str(tmp_path / "out"))
    assert [tuple(r) for r in extraction.summary(made, seconds=2.0, max_char_buffer=5).collect()] == [(2, 13, 2, 1, 2, 6.5, 3)]
    assert "nothing to show" in review.visualized(made.filter("text = ''"))
    with pytest.raises(InvalidDatasetError):
        sources.write_jsonl(made.limit(0), str(tmp_path / "none"))
    with pytest.raises(InvalidDocumentError):
        sources.write_jsonl(made.withColumn("document_id", F.lit("")), str(tmp_path / "unnamed"))
    assert not [f for f in (tmp_path / "unnamed").glob("*") if f.name == "_SUCCESS"]
    (tmp_path / "bad.jsonl").write_text('{"extractions":[{"alignment_status":"odd"}],"text":"t","document_id":"d"}\n\n')
    with pytest.raises(Exception, match="status"):
        sources.read_jsonl(spark, str(tmp_path / "bad.jsonl")).collect()


def test_s1_s2_literals(spark):
    a, b = (sources.literal(spark, "x", i).collect()[0] for i in (None, "me"))
    assert a.document_id == sources.literal(spark, "x").collect()[0].document_id and a.document_id.startswith("doc_") and b.document_id == "me"


def test_s7_url_column(spark):
    urls = ["http://a.b", " https://a.b/c?d ", "http://localhost:1", "http://1.2.3.4", "http://[::1]/x", "ftp://a.b", "http://ab", "a.b", "http://a .b", "http://"]
    assert [r[0] for r in table(spark, urls).select(sources.url_column(F.col("text"))).collect()] == [sources.is_url(u) for u in urls]


def test_m5_m6_m9_m10_review(spark):
    answer = wrapped({"n": "Ann"}, {"z": "absent"})
    made = plan.extract(table(spark, ["Ann <b>.", "Bob"]), spec(other=lambda p: answer))
    page = review.visualized(made)
    assert "&lt;b&gt;" in page and "z</span>" not in page
    assert extraction.summary(made).collect()[0].asDict() == {"documents": 2, "characters": 11, "extractions": 4, "grounded": 1, "classes": 2}
    assert extraction.summary(made.limit(0)).collect()[0].documents == 0
    with pytest.raises(InvalidDatasetError):
        review.visualized(made.limit(0))
    rows = spark.createDataFrame([("d", c, (0, 1)) for c in "ba"] + [("d", "c", None)], "document_id string, extraction_class string, char_interval struct<start_pos: int, end_pos: int>")
    assert {r.extraction_class: r.color_index for r in review.class_colors(rows).collect()} == {"a": 0, "b": 1}
    assert made.select(F.size(review.valid(F.col("extractions"))).alias("n")).agg(F.sum("n")).collect()[0][0] == 1
    assert spark.range(1).select(extraction.attributes_map(F.lit('{"a":"x","b":["y","z"]}'))).collect()[0][0] == {"a": ["x"], "b": ["y", "z"]}


def test_streams(spark, tmp_path):
    when = datetime.datetime(2026, 1, 1)
    rows = spark.createDataFrame([("a", "Ann 1", when), ("b", "Ann 22", when), ("a", "Ann 1", when)], "document_id string, text string, at timestamp")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    what = plan.Spec(Template("D"), inference.Rules({"n": r"\d+"}))
    unique = streaming.first_seen(stream, "at", "1 hour")
    query = streaming.rows(unique, what).writeStream.format("memory").queryName("found").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(r.extraction_text for r in spark.table("found").collect()) == ["1", "22"]
    query = streaming.annotate(stream.select("document_id", "text"), lambda b: plan.extract(b.dropDuplicates(["document_id"]), what), str(tmp_path / "out"), str(tmp_path / "check"))
    query.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def plain(rows, names):
    key = lambda v: None if v is None else str(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted((tuple(key(r[names.index(n)]) for n in sorted(names)) for r in rows), key=str)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_give_their_sqls_rows(name, spark, sf, duck):
    got = queries.QUERIES[name](spark, sf)
    want = duck.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    assert plain([tuple(r) for r in got.collect()], got.columns) == plain(want.fetchall(), names)


def plain_blocks(source, joined):
    return [tuple(b) for b in difflib.SequenceMatcher(None, source, joined, autojunk=False).get_matching_blocks() if b.size]


def test_align_status_counts_and_pages_are_plain_ones(spark, sf, monkeypatch):
    """The whole plan text by text: chunks, patterns, a general diff, pages built one by one."""
    monkeypatch.setattr(alignment, "matching_blocks", plain_blocks)
    counts, pages = Counter(), {}
    for doc_id, body in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        tokens, found = kernels.regex_tokens(body), []
        for a, b in kernels.chunks(body, tokens, 1000):
            start = tokens[a][1]
            chunk = body[start : tokens[b - 1][2]]
            hits = sorted((m.start(), name, m[0]) for name, pattern in queries.RULES.items() for m in re.finditer(pattern, chunk))
            if hits:
                places = alignment.align(chunk, [h for _, _, h in hits], char_offset=start)
                counts.update((name, g.status if g else "none") for (_, name, _), g in zip(hits, places, strict=True))
                found += [{"extraction_class": name, "extraction_text": h, "char_interval": g and {"start_pos": g.char_start, "end_pos": g.char_end}, "attributes": None} for (_, name, h), g in zip(hits, places, strict=True)]
        if found:
            pages[str(doc_id)] = len(review.page(body, found))
    assert {tuple(r)[:2]: r[2] for r in queries.align_status_counts(spark, sf).collect()} == counts
    assert {r[0]: r[1] for r in queries.viz_html_len(spark, sf).collect()} == pages


def test_entry(spark):
    rows = __spark_entry__.entry(spark).collect()
    assert rows and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert {r.extraction_class for r in rows} <= set(queries.RULES)


def test_r1_fences_of_columns_are_those_of_texts(spark):
    odd = ["```json\n[1]\n```", "a ```{}``` b", "```js\n1``` and ```\n2", "``````", "none", "```JSON {}``` ```\n []\n``` x", "```yaml\na: 1```"]
    rows = table(spark, odd).select("text", text.fence_bodies(F.col("text"), ("json", "js")).alias("bodies")).collect()
    assert all(r.bodies == [body for tag, body in formats.fenced(r.text) if tag in ("", "json", "js")] for r in rows)
