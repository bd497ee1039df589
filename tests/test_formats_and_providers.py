"""Formats (R1-R8), prompts (P1-P9) and providers (I1-I13) without Spark."""

import json

import pytest

from tessellate.functions.formats import Example, Extraction, Format, Template, format_warnings, nullable_schema, strict_schema
from tessellate.operators import extraction, inference, review
from tessellate.sources.documents import is_url
from tessellate.types import FormatError, PromptAlignmentError, PromptTemplateError, ProviderError

ITEMS = {"extractions": [{"a": "x"}]}
BODY = json.dumps(ITEMS)


@pytest.mark.parametrize(
    "options,output",
    [
        ({}, f"```json\n{BODY}\n```"),
        ({}, f"```\n{BODY}\n```"),
        ({}, BODY),
        ({}, f"text ```python\n{BODY}``` more"),
        ({"fences": False}, f"  {BODY} "),
        ({}, '```json\n[{"a": "x"}]\n```'),
        ({}, f"<think>hm {{</think>{BODY}"),
        ({"wrapper": False}, '{"a": "x"}'),
        ({"kind": "yaml"}, "```yaml\nextractions:\n- a: x\n```"),
        ({"kind": "yaml"}, "```yml\nextractions:\n- a: x\n```"),
    ],
)
def test_r1_r2_r3_accepted(options, output):
    assert Format(**options).parse(output) == [{"a": "x"}]


@pytest.mark.parametrize(
    "options,output,strict",
    [
        ({}, "", False),
        ({}, None, False),
        ({}, "null", False),
        ({}, "```json\n{}\n``` ```json\n{}\n```", False),
        ({"strict_fences": True}, BODY, False),
        ({}, "```json\nbroken\n```", False),
        ({}, '{"other": []}', False),
        ({}, '{"extractions": {}}', False),
        ({}, '{"extractions": ["a"]}', False),
        ({}, "3", False),
        ({"allow_list": False}, '[{"a": "x"}]', False),
        ({}, '[{"a": "x"}]', True),
        ({}, f"<think>x</think>{BODY}", True),
        ({"kind": "yaml"}, "```yaml\n- 1: x\n```", False),
        ({"kind": "yaml"}, "```yaml\na: [\n```", False),
    ],
)
def test_r1_r2_r3_r7_refused(options, output, strict):
    with pytest.raises(FormatError):
        Format(**options).parse(output, strict)


def names(found):
    return [(e.extraction_class, e.extraction_text, e.extraction_index, e.group_index) for e in found]


def test_r5_order_by_index_is_stable():
    items = [{"medication": "Ibuprofen", "medication_index": 2, "dosage": "400mg", "dosage_index": 1}, {"medication": "Acetaminophen", "medication_index": 1, "duration": "7 days", "duration_index": 2}]
    got = Format(index_suffix="_index").ordered(items)
    assert names(got) == [("dosage", "400mg", 1, 0), ("medication", "Acetaminophen", 1, 1), ("medication", "Ibuprofen", 2, 0), ("duration", "7 days", 2, 1)]
    assert Format(index_suffix="_index").ordered([{"a": "x"}]) == []


def test_r5_running_numbers_and_values():
    got = Format().ordered([{"a": 1, "a_attributes": {"k": "v"}, "p_index": "0"}, {"b": True, "c": 1000.0}])
    assert names(got) == [("a", "1", 1, 0), ("p_index", "0", 2, 0), ("b", "True", 3, 1), ("c", "1000.0", 4, 1)] and got[0].attributes == {"k": "v"}


@pytest.mark.parametrize("item", [{"a": None}, {"a": ["x"]}, {"a": "x", "a_attributes": "no"}])
def test_r5_bad_values(item):
    with pytest.raises(FormatError):
        Format().ordered([item])


@pytest.mark.parametrize("index", ["one", 1.5])
def test_r5_bad_indexes(index):
    with pytest.raises(FormatError):
        Format(index_suffix="_index").ordered([{"a": "x", "a_index": index}])


TEMPLATE = Template("Find names.", [Example("I am Ann.", [Extraction("name", "Ann", {"sex": "f"})])])


@pytest.mark.parametrize("kind", ["json", "yaml"])
def test_p2_p3_examples_can_be_read_back(kind):
    fmt = Format(kind)
    assert fmt.parse(fmt.example(TEMPLATE.examples[0].extractions)) == [{"name": "Ann", "name_attributes": {"sex": "f"}}]


def test_p1_p4_prompt():
    got = TEMPLATE.render(Format(fences=False, kind="yaml"), "Who?", "Before.")
    assert got == "Find names.\n\nBefore.\n\nExamples\nQ: I am Ann.\nA: extractions:\n- name: Ann\n  name_attributes:\n    sex: f\n\nQ: Who?\nA: "
    assert Template("D").render(Format(), "x", "") == "D\n\nQ: x\nA: "


def test_s9_template_files(tmp_path):
    good = tmp_path / "t.yaml"
    good.write_text("description: d\nexamples:\n- text: t\n  extractions:\n  - extraction_class: c\n    extraction_text: t\n")
    assert Template.read(str(good)).examples[0].extractions[0].extraction_class == "c"
    (tmp_path / "bad.json").write_text("{")
    for path, kind in ((tmp_path / "bad.json", "json"), (tmp_path / "none", "yaml")):
        with pytest.raises(PromptTemplateError):
            Template.read(str(path), kind)


def test_p6_p7_schemas():
    examples = [Example("", [Extraction("a", "x", {"k": "v", "l": ["m"]}), Extraction("b", "y")]), Example("", [Extraction("a", "x", {"k": 3})])]
    item = nullable_schema(examples)["properties"]["extractions"]["items"]["properties"]
    assert item["a_attributes"]["properties"] == {"k": {"type": "string"}, "l": {"type": "array", "items": {"type": "string"}}} and "_unused" in item["b_attributes"]["properties"]
    one, two = strict_schema(examples)["properties"]["extractions"]["items"]["anyOf"]
    assert one["properties"]["a_attributes"]["properties"]["k"] == {"anyOf": [{"type": "integer"}, {"type": "string"}, {"type": "null"}]}
    assert two["properties"]["b_attributes"]["properties"] == {} and one["additionalProperties"] is False


def test_p8_p9_formats_and_warnings():
    assert inference.format_for(inference.Rules({})).fences is False and inference.format_for(inference.Replay({})).fences is True
    assert inference.format_for(inference.Rules({}), fences=True).fences is True
    assert len(format_warnings(Format(wrapper=False), True)) == 2 and format_warnings(Format(fences=False), True) == []
    with pytest.raises(ProviderError):
        inference.Chat("m", "u", kind="yaml", schema={})


def test_a13_examples_are_checked():
    good, bad, inexact = (Example("I am Ann.", [Extraction("n", t)]) for t in ("Ann", "Bob", "Ann Lee"))
    assert extraction.check_examples([good], "error", True) == []
    assert [i["issue_kind"] for i in extraction.check_examples([good, bad, inexact])] == ["failed", "non_exact"]
    assert extraction.check_examples([bad], "off") == []
    assert extraction.check_examples([inexact], "error")
    for args in (([bad], "error"), ([inexact], "error", True)):
        with pytest.raises(PromptAlignmentError):
            extraction.check_examples(*args)


# -- providers ---------------------------------------------------------------------------


def test_i1_rules_and_replay():
    out = inference.Rules({"n": r"\d+"}).infer(["x\nQ: a 1 b 22\nA: "])
    assert json.loads(out[0][0].output)["extractions"] == [{"n": "1", "n_attributes": {}}, {"n": "22", "n_attributes": {}}]
    assert str(inference.ScoredOutput(None)) == "Score: -\nOutput: None"
    with pytest.raises(ProviderError):
        inference.Replay({}).infer(["p"])


def test_i1_i3_settings_order_and_failure():
    class Echo(inference.Provider):
        def answer(self, prompt, **settings):
            if prompt == "bad":
                raise RuntimeError
            return [inference.ScoredOutput(f"{prompt}{settings['t']}")]

    assert [o[0].output for o in Echo(t=1).infer([str(k) for k in range(20)], max_workers=5, t=2)] == [f"{k}2" for k in range(20)]
    with pytest.raises(RuntimeError):
        Echo(t=1).infer(["a", "bad"], max_workers=2)


class Status(Exception):
    def __init__(self, code):
        self.code = code


@pytest.mark.parametrize("errors,calls,fails", [([503, 429], 3, False), ([400], 1, True), ([500] * 9, 4, True)])
def test_i4_retries(errors, calls, fails):
    waits, made = [], []

    def call():
        made.append(1)
        if len(made) <= len(errors):
            raise Status(errors[len(made) - 1])
        return "ok"

    if fails:
        with pytest.raises(Status):
            inference.with_retries(call, sleep=waits.append)
    else:
        assert inference.with_retries(call, sleep=waits.append) == "ok"
    assert len(made) == calls and all(0.5 * 2**k <= w <= 1.5 * 2**k for k, w in enumerate(waits))


def test_i5_i6_requests():
    sent = []
    local = inference.LocalServer("m", post=lambda u, b, h, t: sent.append((u, b, t)) or {"response": "r"})
    assert local.infer(["p"])[0][0].output == "r" and sent[0][1]["format"] == "json" and sent[0][1]["options"]["temperature"] == 0.1 and sent[0][2] == 120.0
    chat = inference.Chat("m", "u", "key", schema={"type": "object"}, temperature=0, post=lambda u, b, h, t: sent.append((b, h)) or {"choices": [{"message": {"content": "c"}}]})
    assert chat.infer(["p"], odd=1)[0][0].output == "c"
    body, headers = sent[1]
    assert body["n"] == 1 and body["temperature"] == 0 and "odd" not in body and body["response_format"]["type"] == "json_schema" and headers["Authorization"] == "Bearer key"


def test_i2_i12_hosted_provider_and_patterns():
    sent = []
    post = lambda url, body, headers, timeout: sent.append((url, body, headers)) or {"candidates": [{"content": {"parts": [{"text": "{"}, {"text": "}"}]}}]}
    made = inference.REGISTRY.make("gemini-x", url="https://models.example.org/v1", api_key="k", schema={"type": "object"}, post=post)
    assert made.answer("p", temperature=0.5, max_tokens=9)[0].output == "{}" and made.raw_output
    url, body, headers = sent[0]
    assert url == "https://models.example.org/v1/models/gemini-x:generateContent" and headers == {"x-goog-api-key": "k"}
    assert body["generationConfig"] == {"temperature": 0.5, "maxOutputTokens": 9, "responseMimeType": "application/json", "responseSchema": {"type": "object"}}
    with pytest.raises(ProviderError):
        made.read({"candidates": []})
    for name in ("mixtral:8x7b", "command-r", "gpt-oss:20b", "someone/some-model-7b"):
        assert inference.REGISTRY.resolve(name) is inference.LocalServer
    assert inference.REGISTRY.resolve("gpt-4o") is inference.Chat


def test_i10_i11_i12_registry(monkeypatch):
    r = inference.Registry()
    r.register("^m", provider=inference.Replay, priority=10)
    r.register("^my", provider="tessellate.operators.inference:Rules")
    r.plugins_loaded = True
    assert r.resolve("mistral") is inference.Replay and r.resolve("my-model") is inference.Rules
    assert r.by_name("^m") is inference.Replay and r.by_name("rul") is inference.Rules
    with pytest.raises(ProviderError):
        r.resolve("zzz")
    with pytest.raises(ProviderError):
        r.make()
    assert isinstance(inference.REGISTRY.make("llama3"), inference.LocalServer)
    monkeypatch.setenv("KEY", "from env")
    chat = inference.REGISTRY.make("gpt-x", key_variable="KEY", url="u")
    assert chat.headers == {"Authorization": "Bearer from env"}
    assert inference.REGISTRY.make("gpt-x", key_variable="KEY", url="u", api_key="own").headers == {"Authorization": "Bearer own"}
    with pytest.raises(ProviderError):
        inference.REGISTRY.make("gpt-x")
    monkeypatch.setattr(inference, "entry_points", lambda group: [type("E", (), {"name": "bad", "load": lambda self: 1 / 0})()])
    broken = inference.Registry()
    broken.load_plugins()
    assert broken.entries == []


def test_k5_secrets_are_hidden():
    assert inference.redacted({"api_key": "x", "text": "y" * 600})["api_key"] == "***" and len(inference.redacted({"text": "y" * 600})["text"]) == 501


# -- addresses and review pages ----------------------------------------------------------


@pytest.mark.parametrize("url,want", [("http://a.b", True), (" https://a.b/c?d ", True), ("http://localhost:1", True), ("http://1.2.3.4", True), ("http://[::1]/x", True), ("ftp://a.b", False), ("http://ab", False), ("a.b", False), ("http://a .b", False), ("http://", False)])
def test_s7_urls(url, want):
    assert is_url(url) is want


def test_m7_highlights():
    colors = {"c": "red", "d": "blue"}
    one = review.highlighted("Hello <world>", [(0, 5, "c")], colors)
    assert one == '<span class="hl" data-i="0" style="background:red">Hello</span> &lt;world&gt;'
    for spans in ([(0, 5, "c"), (0, 3, "d")], [(0, 4, "c"), (2, 6, "d")], [(3, 3, "c")]):
        made = review.highlighted("Hello world", spans, colors)
        depth = 0
        for part in made.split("<")[1:]:
            depth += -1 if part.startswith("/") else 1
            assert depth >= 0
        assert depth == 0


def test_m8_m9_pages():
    found = [{"extraction_class": "c", "extraction_text": "</script>", "char_interval": {"start_pos": 0, "end_pos": 5}, "attributes": {"k": ["a", "b"], "n": None}}, {"extraction_class": "z", "extraction_text": "q", "char_interval": None}]
    made = review.page("Hello world", found)
    assert made.count("</script>") == 1 and '"k": "a, b"' in made and '"n"' not in made and ">z<" not in made
    assert review.page("", [], legend=False).count("hl") >= 1
