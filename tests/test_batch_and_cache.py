"""Answers kept by request (I8) and batch jobs over a whole table (I7, I9)."""

import json
import os
import sys
import threading

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from tessellate.functions.formats import Template
from tessellate.operators import batch, cache, inference
from tessellate.plans import extract as plan
from tessellate.sources import storage
from tessellate.types import ProviderError

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import tests


class Counting(inference.Provider):
    """Writes down every question it gets."""

    def __init__(self, path):
        super().__init__()
        self.path = str(path)

    def answer(self, prompt, **settings):
        with open(self.path, "a", encoding="utf-8") as f:
            f.write(json.dumps(prompt) + "\n")
        return [inference.ScoredOutput(f"{prompt}!", 1.0)]

    def asked(self):
        return sorted(json.loads(x) for x in open(self.path)) if os.path.exists(self.path) else []


def prompts(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "n int, prompt string").repartition(3)


def outputs(rows):
    return {r.n: r.outputs[0].output for r in rows.collect()}


# -- cache -----------------------------------------------------------------------------


def test_i8_each_miss_is_asked_once(spark, tmp_path):
    teller, known = Counting(tmp_path / "asked"), cache.AnswerCache(spark, str(tmp_path / "cache"))
    texts = ["oar", "keel", "oar", "mast", "", "rope"]
    found = known.ask(prompts(spark, texts), teller, "m")
    for _ in range(2):  # whatever reads the result asks nothing
        assert outputs(found) == {k: f"{t}!" for k, t in enumerate(texts)}
    assert teller.asked() == sorted(set(texts)) and known.rows().count() == 5
    again = known.ask(prompts(spark, [*texts, "tar"]), teller, "m", blocks=3)
    assert outputs(again)[6] == "tar!" and len(teller.asked()) == 6 and known.rows().count() == 6
    known.ask(prompts(spark, ["oar"]), teller, "other").collect()
    known.ask(prompts(spark, ["oar"]), teller, "m", settings={"temperature": 1}).collect()
    assert teller.asked().count("oar") == 3


def test_i8_repeated_answers_multiply_nothing(spark, tmp_path):
    known = cache.AnswerCache(spark, str(tmp_path / "cache"))
    key = inference.request_key(F.lit("oar"), "m")
    rows = spark.range(3).select(key.alias("request_key"), F.array(F.struct(F.lit(1.0).alias("score"), F.concat(F.lit("v"), F.col("id").cast("string")).alias("output"))).alias("outputs"))
    known.add(rows.filter("id = 1"), "b")
    known.add(rows.filter("id = 2"), "a")
    known.add(rows.filter("id = 0"), "c")
    assert outputs(known.ask(prompts(spark, ["oar", "oar"]), Counting(tmp_path / "asked"), "m")) == {0: "v2", 1: "v2"}
    with pytest.raises(Exception, match="EXISTS"):
        known.add(rows, "a")


def test_i8_broken_off_runs_keep_their_finished_blocks(spark, tmp_path):
    known, texts = cache.AnswerCache(spark, str(tmp_path / "cache")), [f"t{k}" for k in range(40)]

    class Stopping(Counting):
        def answer(self, prompt, **settings):
            if len(self.asked()) >= 25:
                raise RuntimeError("the power went")
            return super().answer(prompt, **settings)

    with pytest.raises(Exception, match="power"):
        known.ask(prompts(spark, texts), Stopping(tmp_path / "first"), "m", blocks=4)
    kept = known.rows().count()
    later = Counting(tmp_path / "later")
    assert outputs(known.ask(prompts(spark, texts), later, "m", blocks=4)) == {k: f"{t}!" for k, t in enumerate(texts)}
    assert 0 < kept < 40 and len(later.asked()) == 40 - kept and known.rows().count() == 40


def test_i8_cache_as_a_table(spark, tmp_path):
    teller, texts = Counting(tmp_path / "asked"), ["oar", "keel", "oar", "mast", "oar", "keel"]
    none = spark.createDataFrame([], f"request_key string, outputs {inference.OUTPUTS}")
    found, fresh = cache.infer_cached(prompts(spark, texts), teller, none, "m")
    fresh.write.parquet(str(tmp_path / "kept"))
    assert outputs(found) == {k: f"{t}!" for k, t in enumerate(texts)} and teller.asked() == ["keel", "mast", "oar"]
    kept = spark.read.parquet(str(tmp_path / "kept"))
    found, fresh = cache.infer_cached(prompts(spark, texts), teller, kept.union(kept), "m")
    assert found.count() == 6 and fresh.count() == 0 and len(teller.asked()) == 3


# -- batch jobs ------------------------------------------------------------------------


class Killed(BaseException):
    """The driver goes."""


class Service(batch.BatchService):
    """Keeps jobs in memory and answers by files; may forget, refuse, repeat or kill."""

    def __init__(self, folder, lines, reply, polls=1, can_find=True):
        self.folder, self.lines, self.reply, self.polls, self.can_find = str(folder), lines, reply, polls, can_find
        self.sent, self.waits, self.cancelled, self.waited, self.kill_at, self.ended = {}, {}, [], [], None, batch.OVER

    def find(self, job):
        return job if self.can_find and job in self.sent else None

    def send(self, job, path):
        assert job not in self.sent, "paid twice"
        rows = [json.loads(x) for f in sorted(os.listdir(path)) if f.startswith("part-") for x in open(f"{path}/{f}", encoding="utf-8")]
        self.sent[job], self.waits[job] = rows, self.polls
        if self.kill_at == len(self.sent):
            raise Killed
        return job

    def state(self, remote):
        self.waits[remote] -= 1
        return batch.RUNNING if self.waits[remote] >= 0 else self.ended

    def answers(self, remote):
        os.makedirs(self.folder, exist_ok=True)
        with open(f"{self.folder}/{remote}.jsonl", "w", encoding="utf-8") as f:
            f.writelines(json.dumps(y, ensure_ascii=False) + "\n\n" for x in self.sent[remote] for y in self.reply(x))
        return [f"{self.folder}/{remote}.jsonl"]

    def cancel(self, remote):
        self.cancelled.append(remote)


def plain(row):
    return [{"key": row["key"], "output": row["prompt"].upper()}]


def run_of(spark, tmp_path, service, lines=None, **settings):
    return batch.BatchRun(spark, str(tmp_path / "run"), service, lines or batch.PlainLines(), "m", batch=batch.BatchSettings(**settings), sleep=service.waited.append)


TEXTS = [f"text {k % 30} é\nline" for k in range(50)]
WANT = {k: t.upper() for k, t in enumerate(TEXTS)}


def test_i7_i9_requests_are_distinct_and_cut(spark, tmp_path):
    service = Service(tmp_path / "answers", batch.PlainLines(), plain)
    run = run_of(spark, tmp_path, service, most_prompts=7, strict=True)
    assert outputs(run.infer(prompts(spark, TEXTS))) == WANT
    sizes = [len(rows) for rows in service.sent.values()]
    assert sum(sizes) == 30 and max(sizes) <= 7 and run.requests().count() == 30 and run.answers().count() == 30
    before = len(service.sent)
    assert outputs(run.infer(prompts(spark, [*TEXTS, "new"]))) == WANT | {50: "NEW"}  # what comes later is a wave of its own
    assert len(service.sent) == before + 1 and len(run.waves()) == 2
    assert run_of(spark, tmp_path, service).infer(prompts(spark, TEXTS)).count() == 50 and len(service.sent) == before + 1


@pytest.mark.parametrize("kill_at", [1, 3])
def test_i7_i9_killed_runs_go_on(spark, tmp_path, kill_at):
    """The driver dies after the service has got a job, before that is written down."""
    service = Service(tmp_path / "answers", batch.PlainLines(), plain)
    service.kill_at = kill_at
    with pytest.raises(Killed):
        run_of(spark, tmp_path, service, most_prompts=7, most_open=2).infer(prompts(spark, TEXTS))
    assert len(service.sent) == kill_at
    service.kill_at = None
    assert outputs(run_of(spark, tmp_path, service, most_prompts=7, most_open=2, strict=True).infer(prompts(spark, TEXTS))) == WANT
    assert sum(map(len, service.sent.values())) == 30  # the service asserts that no job comes twice


def test_i7_jobs_are_sent_and_collected_side_by_side(spark, tmp_path):
    """A service that takes four jobs at a time gets four; no job waits for the Spark jobs of another."""
    meet = threading.Barrier(4, timeout=60)

    class Many(Service):
        at_once = 4

        def send(self, job, path):
            meet.wait()
            return super().send(job, path)

    service = Many(tmp_path / "answers", batch.PlainLines(), plain)
    texts = [f"{k}" for k in range(20)]
    run = run_of(spark, tmp_path, service, most_prompts=20, most_open=4, strict=True)
    run.prepare(prompts(spark, texts))
    run.jobs = lambda found=run.jobs(): {f"{j}-{k}": p for j, p in found.items() for k in range(8)}
    collected, one = threading.Barrier(4, timeout=60), run._collect
    run._collect = lambda *x: (collected.wait(), one(*x))
    run.drive()
    assert len(service.sent) == 8 and run.answers().count() == 20


def test_i7_i9_killed_while_waiting(spark, tmp_path):
    service = Service(tmp_path / "answers", batch.PlainLines(), plain, polls=3, can_find=False)

    def sleep(seconds):
        raise Killed

    run = batch.BatchRun(spark, str(tmp_path / "run"), service, batch.PlainLines(), "m", batch=batch.BatchSettings(most_prompts=10), sleep=sleep)
    with pytest.raises(Killed):
        run.infer(prompts(spark, TEXTS))
    sent = len(service.sent)
    assert outputs(run_of(spark, tmp_path, service, most_prompts=10).infer(prompts(spark, TEXTS))) == WANT and len(service.sent) == sent >= 3


def test_i7_i9_missing_failed_and_repeated_answers(spark, tmp_path):
    def reply(row):
        if row["prompt"].startswith("text 4 "):
            return []
        if row["prompt"].startswith("text 5 "):
            return [{"key": row["key"], "error": "refused"}]
        if row["prompt"].startswith("text 6 "):
            return [{"key": row["key"], "error": "slow"}, *plain(row), *plain(row)]
        return plain(row)

    service = Service(tmp_path / "answers", batch.PlainLines(), reply)
    with pytest.raises(ProviderError, match="refused"):
        run_of(spark, tmp_path, service).infer(prompts(spark, TEXTS))
    found = outputs(run_of(spark, tmp_path, service, ignore_errors=True).infer(prompts(spark, TEXTS)))
    assert len(service.sent) == 1 and found == WANT | {k: "" for k, t in enumerate(TEXTS) if t.startswith(("text 4 ", "text 5 "))}
    silent = Service(tmp_path / "other", batch.PlainLines(), lambda row: [])
    with pytest.raises(ProviderError, match="without an answer"):
        run_of(spark, tmp_path / "strict", silent, strict=True).infer(prompts(spark, ["a", "b"]))


def test_i7_i9_jobs_that_fail_or_take_too_long(spark, tmp_path):
    service = Service(tmp_path / "answers", batch.PlainLines(), plain, polls=99)
    with pytest.raises(ProviderError, match="longer"):
        run_of(spark, tmp_path, service, timeout_seconds=60, poll_seconds=25).infer(prompts(spark, TEXTS))
    assert service.waited == [25] * 3 and len(service.cancelled) == 1
    failing = Service(tmp_path / "failing", batch.PlainLines(), plain, polls=0)
    failing.ended = batch.FAILED
    with pytest.raises(ProviderError, match="ended as failed"):
        run_of(spark, tmp_path / "b", failing).infer(prompts(spark, ["a"]))


def test_i7_few_requests_are_asked_one_by_one(spark, tmp_path):
    service, teller = Service(tmp_path / "answers", batch.PlainLines(), plain), Counting(tmp_path / "asked")
    run = batch.BatchRun(spark, str(tmp_path / "run"), service, batch.PlainLines(), "m", batch=batch.BatchSettings(threshold=4), single=teller)
    for _ in range(2):
        assert outputs(run.infer(prompts(spark, ["a", "b", "a"]))) == {0: "a!", 1: "b!", 2: "a!"}
    assert not service.sent and teller.asked() == ["a", "b"]
    assert outputs(run.infer(prompts(spark, ["a", "c", "d", "e", "f"]))) == {0: "a!", 1: "C", 2: "D", 3: "E", 4: "F"} and len(service.sent) == 1


def test_i7_i9_lines_of_hosted_services(spark, tmp_path):
    keyed = batch.KeyedLines(inference.Generative("m", "https://models.example.org/v1", api_key="k", temperature=0.5))
    text = lambda row: row["request"]["contents"][0]["parts"][0]["text"]
    service = Service(tmp_path / "a", keyed, lambda row: [{"key": row["key"], "response": {"candidates": [{"content": {"parts": [{"text": text(row)}, {"text": "."}]}}]}}])
    assert outputs(run_of(spark, tmp_path, service, keyed).infer(prompts(spark, ["x", "ÿ"]))) == {0: "x.", 1: "ÿ."}
    assert all(row["request"]["generationConfig"] == {"temperature": 0.5} and "k" not in row["request"] for rows in service.sent.values() for row in rows)
    calls = batch.CallLines(inference.Chat("m", "https://chat.example.org", kind="yaml"))
    said = lambda row: {"status_code": 200, "body": {"choices": [{"message": {"content": row["body"]["messages"][-1]["content"][::-1]}}]}}
    service = Service(tmp_path / "b", calls, lambda row: [{"custom_id": row["custom_id"], "response": said(row), "error": None}])
    assert outputs(run_of(spark, tmp_path / "c", service, calls, strict=True).infer(prompts(spark, ["abc"]))) == {0: "cba"}
    (rows,) = service.sent.values()
    assert rows[0]["method"] == "POST" and rows[0]["url"].endswith("/chat/completions") and rows[0]["body"]["model"] == "m"
    assert calls.answer({"custom_id": "q", "response": {"status_code": 429, "body": {}}})[2] and keyed.answer({"key": "q", "response": {"candidates": []}})[2] and keyed.answer({"key": "q"})[2]


def test_i7_i8_the_plan_by_jobs_and_by_cache(spark, tmp_path):
    docs = spark.createDataFrame([("d", "Buoy 7 drifts. Buoy 12 holds."), ("e", ""), ("f", "Buoy 7 drifts. Buoy 12 holds.")], "document_id string, text string")
    rules = inference.Rules({"number": r"\d+"})
    spec = plan.Spec(Template("Find numbers."), rules)
    direct = sorted(map(str, plan.extract(docs, spec).collect()))
    service = batch.OfflineService(spark, str(tmp_path / "service"), rules)
    run = batch.BatchRun(spark, str(tmp_path / "run"), service, batch.PlainLines(), "m", batch=batch.BatchSettings(strict=True))
    assert sorted(map(str, plan.extract(docs, spec, answered=run.infer).collect())) == direct and run.requests().count() == 1
    known = cache.AnswerCache(spark, str(tmp_path / "cache"))
    assert sorted(map(str, plan.extract(docs, spec, answered=lambda p: known.ask(p, rules, "m")).collect())) == direct


def test_i7_settings():
    for bad in ({"threshold": 0}, {"most_prompts": 0}, {"poll_seconds": 0}, {"timeout_seconds": -1}, {"most_open": 0}, {"strict": True, "ignore_errors": True}):
        with pytest.raises(ValueError):
            batch.BatchSettings(**bad)


def test_small_files(spark, tmp_path):
    at = f"file://{tmp_path}/in/a"
    assert storage.get_text(spark, at) is None and storage.names(spark, f"file://{tmp_path}/in") == []
    storage.put_text(spark, at, "é")
    storage.put_text(spark, at, "ü")
    assert storage.get_text(spark, at) == "ü" and storage.names(spark, f"file://{tmp_path}/in") == ["a"] and storage.exists(spark, at)
