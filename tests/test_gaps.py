"""Details of sources (S4, S6, S8), providers (I5, I12, I13), formats (R6-R8) and logs (K5)."""

import io
import json
import logging
import pathlib
import sys
import urllib.error
import warnings

import pytest
from pyspark import cloudpickle

from tessellate.functions.formats import Format, Template
from tessellate.operators import inference
from tessellate.plans import extract as plan
from tessellate.sources import documents as sources
from tessellate.sources import downloads
from tessellate.types import InvalidDatasetError, InvalidDocumentError, ProviderError

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import tests
EXAMPLE = pathlib.Path(__file__).parent.parent / "examples" / "keyword_provider"


# -- sources ---------------------------------------------------------------------------


def test_s2_documents_of_an_iterable(spark):
    drawn = []

    def items():
        for k in range(7):
            drawn.append(k)
            yield [f"text {k}", {"text": f"text {k}", "document_id": f"d{k}"}, (f"t{k}", f"text {k}", "own")][k % 3]

    rows = sources.from_iterable(spark, items(), rows_a_part=3).collect()
    assert drawn == list(range(7)) and sorted(r.text for r in rows) == [f"text {k}" for k in range(7)]
    assert {r.document_id for r in rows} == {"d1", "d4", "t2", "t5", *(sources.literal(spark, f"text {k}").collect()[0].document_id for k in (0, 3, 6))}
    assert {r.additional_context for r in rows} == {None, "own"} and sources.from_iterable(spark, []).count() == 0
    with pytest.raises(InvalidDocumentError):
        sources.from_iterable(spark, [{"text": "a", "colour": "red"}])


def test_s4_missing_and_empty_csv(spark, tmp_path):
    with pytest.raises(OSError, match="absent"):
        sources.read_csv(spark, str(tmp_path / "absent.csv"), "id", "note")
    (tmp_path / "none.csv").write_text("")
    with pytest.raises(InvalidDatasetError, match="empty"):
        sources.read_csv(spark, str(tmp_path / "none.csv"), "id", "note")
    (tmp_path / "a.csv").write_text("id,note\n1,x\n")
    assert sources.read_csv(spark, str(tmp_path / "*.csv"), "id", "note").count() == 1


def test_s6_unknown_keys_of_extractions_raise(spark, tmp_path):
    good = {"extractions": [{"extraction_class": "a", "extraction_text": "b", "attributes": {"any": ["key"]}}], "text": "b", "document_id": "d", "more": 1}
    (tmp_path / "good.jsonl").write_text(json.dumps(good) + "\n" + json.dumps({"extractions": None, "text": "t", "document_id": "e"}) + "\n")
    rows = sources.read_jsonl(spark, str(tmp_path / "good.jsonl")).orderBy("document_id").collect()
    assert rows[0].extractions[0].extraction_text == "b" and rows[1].extractions is None and rows[0].asDict().keys() == {"extractions", "text", "document_id"}
    (tmp_path / "odd.jsonl").write_text(json.dumps(good | {"extractions": [good["extractions"][0] | {"colour": "red"}]}) + "\n")
    with pytest.raises(Exception, match="colour"):
        sources.read_jsonl(spark, str(tmp_path / "odd.jsonl")).collect()


def test_s8_downloads_keep_to_the_pace_and_give_errors_as_rows(spark):
    urls = [f"http://{h}.example.org/{k}" for h in ("a", "b") for k in range(4)] + ["no address", " http://a.example.org/0", "http://a.example.org/0", None, "http://c.example.org/broken"]

    def get(url):
        if "broken" in url:
            raise ConnectionError("refused")
        return url.upper()

    table = spark.createDataFrame([(u,) for u in urls], "url string")
    log = spark.sparkContext.accumulator(0)
    rows = downloads.fetched(table, get=get, per_second=50.0, sleep=lambda s: log.add(1)).collect()
    found = {r.url: (r.text, r.error) for r in rows}
    assert len(rows) == len(found) == 11 and found["http://b.example.org/3"] == ("HTTP://B.EXAMPLE.ORG/3", None) and found[" http://a.example.org/0"][0] == "HTTP://A.EXAMPLE.ORG/0"
    assert found["no address"] == (None, "not an address") and found["http://c.example.org/broken"] == (None, "ConnectionError: refused")
    assert log.value >= 3 + 4 + 2  # between the addresses of a host, and before the further tries


# -- providers -------------------------------------------------------------------------


def test_i5_chat_call_of_one_family():
    sent = []
    post = lambda url, body, headers, timeout: sent.append((url, body)) or {"message": {"content": "{}"}}
    made = inference.LocalServer("gpt-oss:20b", url="http://models.example.org/", post=post)
    assert made.answer("p", seed=3, max_tokens=9, stop=["#"])[0].output == "{}"
    url, body = sent[0]
    assert url == "http://models.example.org/api/chat" and [m["role"] for m in body["messages"]] == ["system", "user"] and "format" not in body and "prompt" not in body
    assert body["options"]["seed"] == 3 and body["options"]["num_predict"] == 9 and body["stop"] == ["#"] and body["think"] is False
    yaml = inference.LocalServer("gpt-oss:20b", kind="yaml", post=lambda u, b, h, t: sent.append((u, b)) or {"response": "a: 1"})
    assert yaml.answer("p")[0].output == "a: 1" and sent[-1][0].endswith("/api/generate") and "format" not in sent[-1][1]


def test_i5_errors_of_local_servers():
    def missing(url, body, headers, timeout):
        raise urllib.error.HTTPError(url, 404, "not found", {}, io.BytesIO())

    with pytest.raises(ProviderError, match="doesn't have the model 'm'"):
        inference.LocalServer("m", post=missing).answer("p")
    for answer, what in (({"thinking": "hm", "response": ""}, "reasoning"), ({}, "without text")):
        with pytest.raises(ProviderError, match=what):
            inference.LocalServer("m", post=lambda u, b, h, t, a=answer: a).answer("p")
    assert inference.LocalServer("m", post=lambda u, b, h, t: {"response": ""}).answer("p")[0].output == ""


def test_i12_environment(monkeypatch):
    for name in ("OPENAI_API_KEY", "GEMINI_API_KEY", "TESSELLATE_API_KEY", "OLLAMA_BASE_URL"):
        monkeypatch.delenv(name, raising=False)
    make = inference.REGISTRY.make
    assert make("llama3").url == "http://localhost:11434/api/generate"
    monkeypatch.setenv("OLLAMA_BASE_URL", "http://models.example.org:99")
    assert make("llama3").url == "http://models.example.org:99/api/generate" and make("llama3", url="http://own.example.org").url == "http://own.example.org/api/generate"
    monkeypatch.setenv("TESSELLATE_API_KEY", "general")
    assert make("gpt-4o", url="u").headers == {"Authorization": "Bearer general"} and make("gpt-4o", url="u", api_key="own").headers == {"Authorization": "Bearer own"}
    monkeypatch.setenv("OPENAI_API_KEY", "special")
    with pytest.warns(UserWarning, match="OPENAI_API_KEY is used"):
        assert make("gpt-4o", url="u").headers == {"Authorization": "Bearer special"}
    assert make("gemini-x", url="u").headers == {"x-goog-api-key": "general"}
    for name, kind in (("gpt4.1-mini", inference.Chat), ("gpt5.2", inference.Chat), ("codegemma:2b", inference.LocalServer)):
        assert inference.REGISTRY.resolve(name) is kind


def test_i13_the_example_plug_in(spark, monkeypatch):
    monkeypatch.syspath_prepend(str(EXAMPLE))
    toml = (EXAMPLE / "pyproject.toml").read_text()
    assert f'entry-points."{inference.ENTRY_POINTS}"' in toml and 'keyword = "keyword_provider:Keywords"' in toml
    import keyword_provider

    cloudpickle.register_pickle_by_value(keyword_provider)
    point = type("Point", (), {"name": "keyword", "load": lambda self: keyword_provider.Keywords})()
    monkeypatch.setattr(inference, "entry_points", lambda group: [point] if group == inference.ENTRY_POINTS else [])
    monkeypatch.delenv(inference.PLUGINS_OFF, raising=False)
    registry = inference.Registry()
    made = registry.make("keyword-small", words=["rye", "salt"])
    docs = spark.createDataFrame([("d", "Salted rye, a pinch of salt."), ("e", "nothing")], "document_id string, text string")
    rows = plan.extract(docs, plan.Spec(Template("Find words."), made)).orderBy("document_id").collect()
    assert [[(e.extraction_text, e.alignment_status) for e in r.extractions] for r in rows] == [[("rye", "match_exact"), ("salt", "match_exact")], []]
    monkeypatch.setenv(inference.PLUGINS_OFF, "1")
    with pytest.raises(ProviderError):
        inference.Registry().make("keyword-small", words=["rye"])


# -- formats and logs ------------------------------------------------------------------


def test_r6_old_parameter_names():
    with pytest.warns(DeprecationWarning, match="fence_output"):
        fmt, rest = Format.of({"fence_output": False, "format_type": type("Kind", (), {"value": "yaml"})(), "require_extractions_key": False, "extraction_attributes_suffix": "_more", "threshold": 0.5, "strict_fences": None}, allow_list=False)
    assert (fmt.fences, fmt.kind, fmt.wrapper, fmt.attribute_suffix, fmt.allow_list, fmt.strict_fences) == (False, "yaml", False, "_more", False, False) and rest == {"threshold": 0.5}
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        assert Format.of({"other": 1}) == (Format(), {"other": 1})


def test_r7_r8_plain_outputs():
    assert inference.Rules({}).parse('[{"a": 1}]') == [{"a": 1}]
    assert inference.LocalServer("m", kind="yaml").parse("a:\n- b") == {"a": ["b"]}
    for bad in ("{", "```json\n{}\n```"):
        with pytest.raises(ValueError):
            inference.Rules({}).parse(bad)


def test_k5_logged_calls(caplog):
    told = inference.Logged(inference.Replay({"short": "x" * 30}, api_key="secret", note="n" * 30), chars=10)
    with caplog.at_level(logging.DEBUG, logger=inference.__name__):
        assert told.infer(["short"], temperature=1)[0][0].output == "x" * 30
        with pytest.raises(ProviderError):
            told.answer("not recorded at all", api_key="secret")
    said = caplog.text
    assert "secret" not in said and "x" * 11 not in said and "n" * 11 not in said and "'short'" in said and "20 more" in said and "failed after" in said and "temperature" in said


def test_t2_a_batch_is_worked_on_in_slices(spark, monkeypatch):
    """Tokens, results and pages are never made of a whole Arrow batch of long texts: no call has more than a slice."""
    import pyarrow as pa
    from pyspark.sql import functions as F

    from tessellate.operators import documents

    texts = pa.array(["", None, "x" * 300, "é" * 100, "y" * 150, None, "z"])
    assert [(k, len(x)) for k, x in documents.slices(texts, 250)] == [(0, 2), (2, 1), (3, 1), (4, 3)]
    assert [(k, len(x)) for k, x in documents.slices(texts.slice(2), 350)] == [(0, 1), (1, 3), (4, 1)] and list(documents.slices(texts.slice(0, 0))) == []
    many = spark.range(40).repartition(1).select("id", F.repeat(F.lit("some words, "), F.lit(20_000)).alias("text"))
    sizes = documents.tokenized(many, "unicode").mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([len(b)])], ["n"]) for b in batches), "n bigint")
    counted = documents.tokenized(many, "unicode").select(F.size("tokens").alias("n")).distinct().collect()
    assert [r.n for r in counted] == [60_000] and sum(r.n for r in sizes.collect()) == 40
    seen, whole = [], documents._token_rows
    monkeypatch.setattr(documents, "_token_rows", lambda texts, tokenizer: (seen.append(sum(map(len, texts))), whole(texts, tokenizer))[1])
    run = {}
    monkeypatch.setattr(type(many), "mapInArrow", lambda self, f, schema: run.setdefault("f", f))
    documents.tokenized(many, "unicode")
    batch = pa.RecordBatch.from_arrays([pa.array(range(4)), *[pa.array(["a b " * 50_000] * 4)] * 2], ["id", "text", "_text"])
    assert [len(b) for b in run["f"](iter([batch]))] == [1] * 4 and max(seen) == 200_000
