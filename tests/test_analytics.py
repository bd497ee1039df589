"""Sketches, table functions (T1, T8, C1), run metrics (K4, M10) and groups by attribute."""

import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessellate.functions.formats import Template
from tessellate.operators import documents, extraction, inference, metrics, sketches, tables
from tessellate.plans import extract as plan

TEXTS = ["Pump 4 failed. Dr. Obi saw it.\nNo leak (yet)!", "", None, "Valve 12, valve 12: shut?! 日本", "a b c " * 40]


@pytest.fixture(scope="module")
def docs(spark):
    table = spark.createDataFrame([(str(k), t) for k, t in enumerate(TEXTS)], "document_id string, text string")
    table.createOrReplaceTempView("some_docs")
    tables.register(spark)
    return table


@pytest.mark.parametrize("tokenizer", ["regex", "unicode"])
def test_t1_t8_c1_table_functions_are_the_operators(spark, docs, tokenizer):
    for call, operator in (
        (f"tokens(text, '{tokenizer}')", documents.token_rows(docs, tokenizer=tokenizer)),
        (f"sentences(text, '{tokenizer}')", documents.sentence_rows(docs, tokenizer=tokenizer)),
        (f"chunks(text, 15, '{tokenizer}')", documents.chunked(docs, 15, tokenizer)),
    ):
        found = spark.sql(f"SELECT d.document_id, t.* FROM some_docs d, LATERAL {call} t")
        assert found.schema.names == operator.schema.names and [f.dataType for f in found.schema] == [f.dataType for f in operator.schema]
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, operator.collect()))


def test_t1_c1_table_functions_refuse_what_they_cant_use(spark, docs):
    assert spark.sql("SELECT count(*) FROM tokens('one 2 three')").collect()[0][0] == 3
    for bad in ("tokens(7)", "chunks('a', 0)", "tokens('a', 'odd')", "chunks('a')"):
        with pytest.raises(Exception, match="UDTF|TABLE_VALUED|UNEXPECTED|analyze|1|no string|odd"):
            spark.sql(f"SELECT * FROM {bad}").collect()


def test_sketches_merge_and_stay_within_their_bounds(spark):
    rng = random.Random(3)
    rows = [(f"day{rng.randrange(6)}", rng.randrange(4000), int(rng.lognormvariate(5, 1)), rng.choices("abcdefg", weights=[40, 20, 10, 5, 2, 1, 1])[0]) for _ in range(12_000)]
    table = spark.createDataFrame(rows, "day string, doc int, size int, kind string")
    states = sketches.summarized(table, ["day"], "doc", "size", "kind")
    twice = sketches.merged(sketches.merged(states.withColumn("half", F.col("day") < "day3"), ["half"]), [])
    row = twice.select("n", sketches.n_distinct(F.col("distinct")).alias("d"), sketches.quantiles(F.col("quantiles"), 0.1, 0.5, 0.9).alias("q"), sketches.top(F.col("frequent"), 3).alias("t")).collect()[0]
    sizes = sorted(r[2] for r in rows)
    assert row.n == 12_000 and abs(row.d - len({r[1] for r in rows})) < 0.025 * 4000
    for share, value in zip((0.1, 0.5, 0.9), row.q, strict=True):
        assert sum(s < value for s in sizes) / 12_000 <= share + 0.02 and sum(s <= value for s in sizes) / 12_000 >= share - 0.02
    assert [(x["item"], x["count"]) for x in row.t] == Counter(r[3] for r in rows).most_common(3)


def annotated(spark):
    docs = spark.createDataFrame([("a", "Ann met Bob at 9."), ("b", "no"), ("c", "At 10, at 11.")], "document_id string, text string")
    return docs, plan.extract(docs, plan.Spec(Template("D"), inference.Rules({"name": "Ann|Bob", "hour": r"\d+"})))


def test_k4_m10_one_pass_gives_the_summary(spark, tmp_path):
    _, made = annotated(spark)
    watched, observation = metrics.observed(made, ["name", "place"])
    watched.write.parquet(str(tmp_path / "out"))
    found = metrics.run_summary(observation.get, seconds=2.0)
    want = extraction.summary(made, seconds=2.0).collect()[0].asDict()
    assert {k: found[k] for k in want} == want and found["by_class"] == {"name": 2} and found["other"] == 3
    empty, observation = metrics.observed(made.limit(0), ["name"])
    empty.write.parquet(str(tmp_path / "none"))
    assert metrics.run_summary(observation.get) == {"documents": 0, "characters": 0, "extractions": 0, "grounded": 0, "by_class": {}, "other": 0, "classes": 0}


def test_k4_streams_tell_their_progress(spark, tmp_path):
    _, made = annotated(spark)
    made.coalesce(1).write.parquet(str(tmp_path / "in"))
    said = []
    listener = metrics.ProgressLog(said.append)
    spark.streams.addListener(listener)
    try:
        stream, _ = metrics.observed(spark.readStream.schema(made.schema).parquet(str(tmp_path / "in")), ["name", "hour"])
        query = stream.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
        query.awaitTermination()
        for _ in range(100):
            if said and said[-1]["batch"] is None:
                break
            import time

            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    assert said[0]["documents"] == 3 and said[0]["by_class"] == {"name": 2, "hour": 3} and said[-1]["batch"] is None and said[-1]["grounded"] == 5


def test_groups_by_attribute(spark):
    rng = random.Random(8)
    rows = []
    for k in range(400):
        attributes = {"all": "same", "color": rng.choice(["red", "blue"])} if k % 5 else None
        if attributes and k % 3 == 0:
            attributes["tags"] = [rng.choice("xyz") for _ in range(3)]
        rows.append((f"d{k % 37}", "thing", f"t{k % 11}" if k % 13 else None, None if attributes is None else json.dumps(attributes)))
    table = spark.createDataFrame(rows, "document_id string, extraction_class string, extraction_text string, attributes string")
    want = {}
    for d, _, t, a in rows:
        for name, value in json.loads(a or "{}").items():
            for v in set(value if isinstance(value, list) else [value]):
                want.setdefault((name, v), []).append((d, t))
    found = {(r.attribute, r.value): tuple(r)[2:] for r in extraction.attribute_groups(extraction.attribute_rows(table), salts=4).collect()}
    assert found == {k: (len(x), len({d for d, _ in x}), len({t for _, t in x} - {None}), min(t for _, t in x if t)) for k, x in want.items()}
