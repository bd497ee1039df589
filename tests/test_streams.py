"""Streams: chunks out of order (P5), sessions, joins of two streams, late rows; each against its batch plan."""

import datetime
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from tessellate.functions.formats import Template
from tessellate.operators import documents, inference
from tessellate.plans import extract as plan
from tessellate.streaming import context, events
from tessellate.streaming import extract as streaming

START = datetime.datetime(2026, 1, 1, tzinfo=datetime.timezone.utc)


def at(minutes):
    return START + datetime.timedelta(minutes=minutes)


def stream_of(spark, folder, schema, batches):
    """A stream that reads one list of rows after the other."""
    folder.mkdir()
    for k, rows in enumerate(batches):
        with open(folder / f"{k:03d}.json", "w", encoding="utf-8") as f:
            f.writelines(json.dumps(r, default=lambda x: x.isoformat()) + "\n" for r in rows)
        os.utime(folder / f"{k:03d}.json", (1_700_000_000 + k, 1_700_000_000 + k))  # files are read by age
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))


def run(stream, name, tmp_path):
    query = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name).collect()


@pytest.fixture
def rocks(spark):
    spark.conf.set(*context.STORE)
    yield
    spark.conf.unset(context.STORE[0])


CHUNK = "document_id string, chunk_index int, chunk_text string, additional_context string, at timestamp"


def test_p5_chunks_out_of_order_get_the_batch_plans_contexts(spark, rocks, tmp_path):
    rng = random.Random(4)
    rows = [{"document_id": f"d{d}", "chunk_index": k, "chunk_text": f"tale {d} part {k} " + "la " * rng.randrange(9), "additional_context": "sung" if d % 3 == 0 else None, "at": at(d + 0.1 * k)} for d in range(8) for k in range(rng.randint(1, 9))]
    table = spark.createDataFrame([tuple(r.values()) for r in rows], CHUNK)
    want = {(r.document_id, r.chunk_index): r.context for r in documents.with_previous(table, 12).collect()}
    rng.shuffle(rows)
    stream = stream_of(spark, tmp_path / "in", CHUNK, [rows[k::5] for k in range(5)])
    found = run(documents.in_context(context.previous(stream, "at", "1 hour", 12)), "told", tmp_path)
    assert {(r.document_id, r.chunk_index): r.context for r in found} == want and len(found) == len(rows)


def test_p5_state_is_dropped_and_orphans_go_without_context(spark, rocks, tmp_path):
    row = lambda d, k, minute: {"document_id": d, "chunk_index": k, "chunk_text": f"{d}{k}", "at": at(minute)}
    batches = [[row("a", 0, 0), row("a", 2, 0)], [row("b", 0, 50)], [row("c", 0, 100)], [row("d", 0, 101)], [row("e", 0, 102)]]
    stream = stream_of(spark, tmp_path / "in", CHUNK, batches)
    found = run(context.previous(stream, "at", "1 minute", 5, hold_ms=60_000), "orphans", tmp_path)
    assert {(r.document_id, r.chunk_index): r.previous for r in found} == {("a", 0): None, ("a", 2): None, ("b", 0): None, ("c", 0): None, ("d", 0): None, ("e", 0): None}
    spark.conf.unset(context.STORE[0])
    with pytest.raises(ValueError, match="stateStore"):
        context.previous(stream, "at", "1 minute", 5)


def test_p5_documents_in_a_stream_have_context(spark, tmp_path):
    texts = ["The ferry left at 9. It came back at 17. Nobody saw 3 gulls.", "One 1. Two 22."]
    docs = spark.createDataFrame([(str(k), t) for k, t in enumerate(texts)], "document_id string, text string")
    spec = plan.Spec(Template("D"), inference.Rules({"n": r"\d+"}), max_char_buffer=22, context_window_chars=10)
    shown = plan.prompts(docs, spec)
    window = documents.with_previous(documents.chunked(docs, 22), 10)
    assert sorted((r.document_id, r.chunk_index, r.context or "") for r in shown.collect()) == sorted((r.document_id, r.chunk_index, r.context or "") for r in window.collect())
    assert "Window" not in shown._jdf.queryExecution().optimizedPlan().toString()
    stream = stream_of(spark, tmp_path / "in", "document_id string, text string", [[{"document_id": str(k), "text": t}] for k, t in enumerate(texts)])
    found = run(streaming.rows(stream, spec), "numbers", tmp_path)
    assert sorted(r.extraction_text for r in found) == ["1", "17", "22", "3", "9"]


EVENT = "document_id string, n int, at timestamp"


def test_sessions_of_a_stream_are_those_of_the_table(spark, tmp_path):
    """Late rows that extend and join sessions count; rows behind the watermark don't."""
    rng = random.Random(6)
    rows = [{"document_id": rng.choice("pqr"), "n": k, "at": at(rng.uniform(0, 300))} for k in range(120)]
    rows.sort(key=lambda r: r["at"] + datetime.timedelta(minutes=rng.uniform(0, 25)))  # up to 25 minutes late
    table = spark.createDataFrame([tuple(r.values()) for r in rows], EVENT)
    measures = F.min("n").alias("first"), F.sum("n").alias("sum")
    want = sorted(map(str, events.sessions(table, ["document_id"], "at", "6 minutes", None, *measures).collect()))
    last = [{"document_id": "end", "n": 0, "at": at(1000)}, {"document_id": "p", "n": 0, "at": at(1)}]  # the second is far too late
    stream = stream_of(spark, tmp_path / "in", EVENT, [*(rows[k : k + 20] for k in range(0, 120, 20)), last[:1], last[1:], [{"document_id": "end", "n": 0, "at": at(1001)}]])
    found = run(events.sessions(stream, ["document_id"], "at", "6 minutes", "30 minutes", *measures), "sessions", tmp_path)
    assert sorted(str(r) for r in found if r.document_id != "end") == want and len(want) > 10


def test_two_streams_join_like_two_tables(spark, tmp_path):
    rng = random.Random(9)
    seen = [{"document_id": f"d{rng.randrange(15)}", "n": k, "at": at(rng.uniform(0, 200))} for k in range(60)]
    docs = [{"document_id": f"d{k}", "text": f"No {k} and {k + 50}", "found_at": at(rng.uniform(0, 200))} for k in range(15)]
    spec = plan.Spec(Template("D"), inference.Rules({"n": r"\d+"}))
    doc, keys = "document_id string, text string, found_at timestamp", ("document_id", "extraction_text")

    def extracted(rows):
        return streaming.extraction.extraction_rows(plan.resolved(rows, spec), ("document_id", "found_at")).select(*keys, "found_at")

    bounds = {"before": "20 minutes", "after": "30 minutes"}
    want = events.with_events(extracted(spark.createDataFrame([tuple(r.values()) for r in docs], doc)), spark.createDataFrame([tuple(r.values()) for r in seen], EVENT), "found_at", "at", **bounds)
    docs.sort(key=lambda r: r["found_at"] + datetime.timedelta(minutes=rng.uniform(0, 40)))
    seen.sort(key=lambda r: r["at"] + datetime.timedelta(minutes=rng.uniform(0, 40)))
    left = stream_of(spark, tmp_path / "docs", doc, [docs[k : k + 5] for k in range(0, 15, 5)])
    right = stream_of(spark, tmp_path / "events", EVENT, [seen[k : k + 20] for k in range(0, 60, 20)])
    found = run(events.with_events(extracted(left), right, "found_at", "at", delays=("1 hour", "1 hour"), **bounds), "met", tmp_path)
    of = lambda rows: sorted((r.document_id, r.extraction_text, r.n) for r in rows)
    assert of(found) == of(want.collect()) and len(found) > 5
    wide = events.with_events(extracted(spark.createDataFrame([tuple(r.values()) for r in docs], doc)), spark.createDataFrame([], EVENT), "found_at", "at", how="left").collect()
    assert len(wide) == 30 and all(r.n is None for r in wide)
