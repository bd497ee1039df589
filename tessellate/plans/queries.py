"""Registered queries over the test tables, each with the SQL that gives the same rows."""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions.formats import Example, Extraction, Template
from ..operators import batch, cache, documents, extraction, inference, intervals, review, sketches
from ..sources import documents as sources
from ..sources import storage
from ..streaming import events
from . import extract as plan

#: What the offline provider looks for.
RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "license": r"Apache License|MIT License|GNU General Public License|CC BY[A-Z-]*",
    "address": r"\b\d{1,3}(?:\.\d{1,3}){3}\b",
    "phone": r"\+?\d[\d ().-]{7,}\d",
}
TEMPLATE = Template("Extract contact details and licences in the order they appear.", [Example("Write to ann@example.org.", [Extraction("email", "ann@example.org")])])


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _as_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.from_table(_docs(spark, sf_dir), "doc_id", "text")


def _as_long(name: str):
    return F.col(name).cast("bigint").alias(name.rpartition(".")[2])


def _long(name: str):
    return F.col(name).cast("bigint").alias(name)


def doc_scan_project(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", "lang", "n_chars")


def doc_filter_lang(spark, sf_dir):
    return _docs(spark, sf_dir).filter(F.col("lang") == "de").groupBy("source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


def doc_prompt_dedup(spark, sf_dir):
    return _docs(spark, sf_dir).agg(F.count("*").alias("n"), F.countDistinct("text").alias("n_distinct"))


def _tokens(spark, sf_dir, *fields):
    return documents.token_rows(_docs(spark, sf_dir), "doc_id", fields=fields)


def token_stats_by_doc(spark, sf_dir):
    return _tokens(spark, sf_dir, "index", "start_pos").groupBy("doc_id").agg(F.count("*").alias("n_tokens"), F.sum("start_pos").alias("sum_start"), F.max("index").cast("bigint").alias("last_index"))


def token_type_counts(spark, sf_dir):
    return _tokens(spark, sf_dir, "token_type").groupBy("token_type").agg(F.count("*").alias("n"))


def newline_flags(spark, sf_dir):
    return _tokens(spark, sf_dir, "index", "first_token_after_newline").filter("first_token_after_newline").groupBy("doc_id").agg(F.count("*").alias("n_breaks"), F.sum("index").alias("sum_index"))


def token_norm_topk(spark, sf_dir):
    words = _tokens(spark, sf_dir, "token", "token_type").filter("token_type = 0").select(text.normalized_token(F.col("token")).alias("token"))
    return words.groupBy("token").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "token").limit(50)


def sentence_stats_by_doc(spark, sf_dir):
    found = documents.sentence_rows(_docs(spark, sf_dir), "doc_id", fields=("token_start", "token_end"))
    return found.groupBy("doc_id").agg(F.count("*").alias("n_sentences"), F.max(F.col("token_end") - F.col("token_start")).cast("bigint").alias("longest"), F.sum("token_start").alias("sum_start"))


def sanitize_text(spark, sf_dir):
    clean = text.sanitized(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", F.length(clean).cast("bigint").alias("n_clean"), F.sha2(clean.cast("binary"), 256).alias("clean_sha256"))


def chunk_stats_by_doc(spark, sf_dir):
    rows = documents.chunked(_as_documents(spark, sf_dir), 1000, fields=("token_start", "char_start", "char_end"))
    return rows.groupBy("document_id").agg(F.count("*").alias("n_chunks"), F.max(F.col("char_end") - F.col("char_start")).cast("bigint").alias("longest"), F.sum("token_start").alias("sum_start"))


def conversation_context(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    rows = documents.with_previous(turns.select(F.col("conv_id").alias("document_id"), F.col("turn").alias("chunk_index"), F.col("text").alias("chunk_text")), 30)
    return rows.select(F.col("document_id").alias("conv_id"), F.col("chunk_index").alias("turn"), "context")


def prompt_render_len(spark, sf_dir):
    rows = _docs(spark, sf_dir).select("doc_id", F.col("text").alias("chunk_text"), F.lit(None).cast("string").alias("context"))
    prompt = extraction.prompted(rows, Template("Find names."), inference.format_for(inference.Rules({})))
    return prompt.select("doc_id", F.length("prompt").cast("bigint").alias("n_prompt"))


def batch_assign(spark, sf_dir):
    return documents.batched(_docs(spark, sf_dir).select("doc_id", "n_chars"), 10, order=("doc_id",), groups=16)


def _outputs(spark, sf_dir):
    body = F.concat(F.lit('{"extractions":[{"role":"'), F.col("role"), F.lit('"}]}'))
    k = F.pmod("turn", F.lit(4))
    made = F.when(k == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(k == 1, body).when(k == 2, F.concat(F.lit("```json\n"), body, F.lit("\n```\n```\n{}\n```"))).otherwise("```json\nbroken\n```")
    return spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", made.alias("output"))


def fence_extract(spark, sf_dir):
    bodies = text.fence_bodies(F.col("output"))
    body = F.when(F.size(bodies) == 1, F.get(bodies, F.lit(0))).when(F.size(bodies) == 0, F.trim("output"))
    return _outputs(spark, sf_dir).select("conv_id", "turn", F.size(bodies).cast("bigint").alias("n_blocks"), body.alias("body"))


def _parsed(spark, sf_dir):
    """The outputs of :func:`_outputs`, parsed and grounded in their turn's text."""
    rows = _outputs(spark, sf_dir).select("conv_id", "turn", F.lit("user and assistant take turns").alias("chunk_text"), F.lit(0).alias("token_start"), F.lit(0).alias("char_start"), F.array(F.struct(F.lit(1.0).alias("score"), "output")).alias("outputs"))
    return extraction.resolved(rows, inference.Format(kind="json", fences=True))


def json_parse_status(spark, sf_dir):
    status = F.when(F.col("result.parse_error").isNull(), "parsed").otherwise("not parsed")
    return _parsed(spark, sf_dir).groupBy(status.alias("status")).agg(F.count("*").alias("n"), F.sum(F.size("result.items")).alias("n_items"))


def exact_alignment(spark, sf_dir):
    """Where the role that each output names stands in a fixed sentence."""
    rows = extraction.extraction_rows(_parsed(spark, sf_dir), ("conv_id", "turn"))
    return rows.select("conv_id", "turn", "extraction_class", "extraction_text", "alignment_status", _as_long("char_interval.start_pos"), _as_long("char_interval.end_pos"), _as_long("token_interval.start_index"))


def _mentions(spark, sf_dir):
    """One row per e-mail address that the offline provider finds in a document."""
    rows = _docs(spark, sf_dir).select("doc_id", F.col("text").alias("chunk_text"), F.lit(None).cast("string").alias("context"))
    provider = inference.Rules({"email": RULES["email"]})
    asked = inference.infer(extraction.prompted(rows, Template("Find addresses."), inference.format_for(provider)), provider)
    items = F.from_json(F.get("outputs", F.lit(0))["output"], "extractions array<struct<email: string>>")["extractions"]
    return asked.select("doc_id", F.posexplode(items).alias("ordinal", "item")).select("doc_id", "ordinal", "item.email")


def rules_mentions(spark, sf_dir):
    return _mentions(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("n_mentions"), F.min_by("email", "ordinal").alias("first"))


def _intervals(spark, sf_dir):
    start = F.pmod("l_partkey", F.lit(100)).cast("bigint")
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", start.alias("s"), (start + F.col("l_quantity").cast("bigint")).alias("e"))


def _overlapping(spark, sf_dir):
    a, b = _intervals(spark, sf_dir).alias("a"), _intervals(spark, sf_dir).alias("b")
    hit = text.overlaps(F.col("a.s"), F.col("a.e"), F.col("b.s"), F.col("b.e"))
    return a, b, (F.col("a.l_orderkey") == F.col("b.l_orderkey")) & (F.col("a.l_linenumber") < F.col("b.l_linenumber")) & hit


def overlap_pairs(spark, sf_dir):
    a, b, on = _overlapping(spark, sf_dir)
    return a.join(b, on).select("a.l_orderkey", F.col("a.l_linenumber").alias("line_a"), F.col("b.l_linenumber").alias("line_b"))


def overlap_semi(spark, sf_dir):
    a, b, on = _overlapping(spark, sf_dir)
    return a.join(b, on, "left_semi").select("l_orderkey", "l_linenumber")


def overlap_anti(spark, sf_dir):
    a, b, on = _overlapping(spark, sf_dir)
    return a.join(b, on, "left_anti").select("l_orderkey", "l_linenumber")


def interval_overlaps(spark, sf_dir):
    """How many intervals each interval overlaps among those of its return flag, which has only three values."""
    start = F.col("l_orderkey").cast("bigint")
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_returnflag", "l_orderkey", "l_linenumber", start.alias("start"), (start + 1 + F.col("l_partkey") % 5 + F.when(F.col("l_partkey") % 100 == 7, 60).otherwise(0)).cast("bigint").alias("end"))
    return intervals.overlap_counts(rows, rows, ["l_returnflag"]).groupBy("l_returnflag", "l_orderkey", "l_linenumber").agg(F.sum("n").alias("n"))


def multipass_merge(spark, sf_dir):
    """The first two intervals of an order are pass one, the others come later, by start and end."""
    place = F.struct(F.col("s").alias("start_pos"), F.col("e").alias("end_pos"))
    n = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("s", "e"))
    rows = _intervals(spark, sf_dir).select("l_orderkey", F.struct(n.alias("n"), place.alias("char_interval")).alias("x"))
    listed = rows.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("x")).alias("all"))
    kept = extraction.merge_passes(F.filter("all", lambda x: x["n"] <= 2), F.filter("all", lambda x: x["n"] > 2))
    return listed.select("l_orderkey", F.array_join(F.transform(kept, lambda x: x["n"].cast("string")), ",").alias("kept"))


def assemble_docs(spark, sf_dir):
    """Two passes that found the same: the second one's extractions overlap the first one's and go."""
    none = lambda kind: F.lit(None).cast(kind)
    place = F.struct(F.col("ordinal").alias("start_pos"), (F.col("ordinal") + 1).alias("end_pos"))
    found = _mentions(spark, sf_dir).select(
        F.col("doc_id").cast("string").alias("document_id"), F.lit(0).alias("chunk_index"), "ordinal", F.lit("email").alias("extraction_class"), F.col("email").alias("extraction_text"), place.alias("char_interval"),
        F.lit("match_exact").alias("alignment_status"), none("int").alias("extraction_index"), none("int").alias("group_index"), none("string").alias("description"), none("string").alias("attributes"),
    )
    rows = found.withColumn("pass", F.lit(0)).unionByName(found.withColumn("pass", F.lit(1)))
    out = extraction.assembled(_as_documents(spark, sf_dir), rows)
    return out.select("document_id", F.array_join(F.transform("extractions", lambda e: e["extraction_text"]), " ").alias("found"))


def _with_attributes(spark, sf_dir):
    """Each document's source as an extraction, with its language and the kinds of its source and size as attributes."""
    size = F.when(F.col("n_chars") < 500, "short").when(F.col("n_chars") < 5000, "middling").otherwise("long")
    attributes = F.to_json(F.struct(F.col("lang").alias("language"), F.array(size, F.lit("text"), F.lit("text")).alias("kinds")))
    return _docs(spark, sf_dir).select(F.col("doc_id").alias("document_id"), F.lit("source").alias("extraction_class"), F.col("source").alias("extraction_text"), attributes.alias("attributes"))


def attribute_groups(spark, sf_dir):
    """Extractions by attribute and value; one value stands on all of them."""
    return extraction.attribute_groups(extraction.attribute_rows(_with_attributes(spark, sf_dir)))


def sketch_states(spark, sf_dir):
    """Sketches kept by source and merged by language: whether they agree with exact numbers within their bounds."""
    rows = _docs(spark, sf_dir).select("lang", "source", "doc_id", "n_chars", F.length("source").alias("size"))
    path = storage.fresh_path(spark, "sketches")
    states = storage.materialized(sketches.summarized(rows, ["lang", "source"], "doc_id", "n_chars", "size"), path)
    found = sketches.merged(states, ["lang"]).select("lang", "n", sketches.n_distinct(F.col("distinct")).alias("about"), F.get(sketches.quantiles(F.col("quantiles"), 0.5), F.lit(0)).alias("middle"), F.get(sketches.top(F.col("frequent"), 1), F.lit(0)).alias("top"))
    below = rows.join(found, "lang").groupBy("lang", "n", "about", "top").agg(F.count_distinct("doc_id").alias("exact"), F.avg((F.col("n_chars") < F.col("middle")).cast("int")).alias("low"), F.avg((F.col("n_chars") <= F.col("middle")).cast("int")).alias("high"))
    return below.select("lang", "n", (F.abs(F.col("about") - F.col("exact")) <= 0.03 * F.col("exact") + 1).alias("distinct_fits"), ((F.col("low") <= 0.53) & (F.col("high") >= 0.47)).alias("median_fits"), F.col("top")["count"].cast("bigint").alias("top_count"))


def class_share(spark, sf_dir):
    n = _docs(spark, sf_dir).groupBy("lang").agg(F.count("*").alias("n"))
    return n.select("lang", "n", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 6).alias("share"))


def mention_topk(spark, sf_dir):
    return _docs(spark, sf_dir).groupBy("source").agg(F.sum("n_chars").alias("chars")).orderBy(F.desc("chars"), "source").limit(10)


def class_rollup(spark, sf_dir):
    return _docs(spark, sf_dir).rollup("lang", "source").agg(F.count("*").alias("n"))


def class_color_index(spark, sf_dir):
    rows = _docs(spark, sf_dir).select(F.col("source").alias("document_id"), F.col("lang").alias("extraction_class"), F.struct(F.lit(0).alias("start_pos"), F.lit(1).alias("end_pos")).alias("char_interval"))
    return review.class_colors(rows).select("document_id", "extraction_class", _long("color_index"))


def event_sessions(spark, sf_dir):
    """A user's events without a pause of twelve hours: how many, how many errors, the first one's id, and how long it lasted."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    measures = F.count(F.when(F.col("event_type") == "error", 1)).alias("n_errors"), F.min("event_id").alias("first_event"), F.expr("timestampdiff(MICROSECOND, min(ts), max(ts))").alias("micros")
    return events.sessions(rows, ["user_id"], "ts", "12 hours", None, *measures).drop("session")


def running_chars(spark, sf_dir):
    """Characters so far by source.  Sums of id blocks run first, so that no window has a whole source's rows."""
    rows = _docs(spark, sf_dir).select("source", "doc_id", "n_chars", F.floor(F.col("doc_id") / 1000).alias("block"))
    by_block = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("source", "block").agg(F.sum("n_chars").alias("n")).select("source", "block", F.coalesce(F.sum("n").over(by_block), F.lit(0)).alias("before"))
    inside = Window.partitionBy("source", "block").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.withColumn("own", F.sum("n_chars").over(inside))
    return summed.join(sums, ["source", "block"]).select("doc_id", (F.col("own") + F.col("before")).alias("chars_so_far"))


def _keyed(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", "lang", inference.request_key(F.col("text"), "model-1").alias("request_key"))


def _answers_of_even_ids(spark, sf_dir):
    """A cache that has the texts of even ids, as often as they occur."""
    return _keyed(spark, sf_dir).filter("doc_id % 2 = 0").select("request_key", F.array(F.struct(F.lit(1.0).alias("score"), F.lit("cached").alias("output"))).alias("outputs"))


def _by_length():
    return inference.Replay({}, other=lambda prompt: f"{len(prompt)} characters")


def _prompts(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.col("text").alias("prompt"))


def _output():
    return F.get("outputs", F.lit(0))["output"].alias("output")


def cached_answers(spark, sf_dir):
    """Texts of even ids are in the cache; every other distinct text is asked once."""
    rows, _ = cache.infer_cached(_prompts(spark, sf_dir), _by_length(), _answers_of_even_ids(spark, sf_dir), "model-1")
    return rows.select("doc_id", "request_key", _output())


def cache_new_rows(spark, sf_dir):
    """What a cache in shared storage has after two runs: the answers put into it, and one for each text asked that it didn't have."""
    kept = cache.AnswerCache(spark, storage.fresh_path(spark, "cache"))
    kept.add(_answers_of_even_ids(spark, sf_dir).repartition(cache.prefix_of(F.col("request_key"))))
    kept.ask(_prompts(spark, sf_dir).filter("doc_id % 3 = 0"), _by_length(), "model-1")
    answered = kept.ask(_prompts(spark, sf_dir), _by_length(), "model-1", blocks=2)
    added = kept.rows().groupBy("request_key").agg(F.count("*").alias("n_rows"))
    return answered.groupBy("request_key", _output()).agg(F.count("*").alias("n_documents")).join(added, "request_key")


def batch_answers(spark, sf_dir):
    """All documents answered by batch jobs of at most 2500 distinct texts."""
    folder = storage.fresh_path(spark, "batch")
    service = batch.OfflineService(spark, f"{folder}/service", _by_length())
    run = batch.BatchRun(spark, f"{folder}/run", service, batch.PlainLines(), "model-1", batch=batch.BatchSettings(most_prompts=2500, strict=True))
    return run.infer(_prompts(spark, sf_dir)).select("doc_id", "request_key", _output())


def cache_hits(spark, sf_dir):
    rows = _keyed(spark, sf_dir)
    return rows.filter("doc_id % 2 = 1").join(rows.filter("doc_id % 2 = 0").select("request_key"), "request_key", "left_semi").select("doc_id", "request_key")


def cache_misses(spark, sf_dir):
    rows = _keyed(spark, sf_dir)
    return rows.filter("doc_id % 2 = 1").join(rows.filter("doc_id % 2 = 0").select("request_key"), "request_key", "left_anti").select("doc_id")


def labels_join_quality(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return _docs(spark, sf_dir).join(labels, "doc_id", "left").groupBy("lang", "quality").agg(F.count("*").alias("n"))


def benchmark_overlap_docs(spark, sf_dir):
    """Eight-word passages that documents share with benchmark items; only shared ones are made distinct."""

    def grams(df, key):
        words = df.select(F.col(key), F.split("text", " ").alias("w")).filter(F.size("w") >= 8)
        starts = F.transform(F.sequence(F.lit(1), F.size("w") - 7), lambda i: F.array_join(F.slice("w", i, 8), " "))
        return words.select(key, F.explode(starts).alias("g"))

    items = grams(spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "item_id").distinct()
    small = items.count() <= 500_000
    shared = grams(_docs(spark, sf_dir), "doc_id").join(F.broadcast(items) if small else items, "g").distinct()
    return shared.groupBy("doc_id", "item_id").agg(F.count("*").alias("n_common"))


def url_predicate(spark, sf_dir):
    """Every page's address and what can be made of it: other schemes, no scheme, hosts without a dot, white space, ports, IP addresses."""
    u = F.col("url")
    path = F.regexp_replace(u, "^https?://[^/]*", "")
    forms = {
        "as it is": u, "other scheme": F.regexp_replace(u, "^https?", "ftp"), "no scheme": F.regexp_replace(u, "^https?://", ""), "blanks around": F.concat(F.lit(" \t"), u, F.lit("\n")), "blank inside": F.concat(u, F.lit(" x")),
        "no dot": F.concat(F.lit("http://host"), path), "local": F.concat(F.lit("http://localhost:80"), path), "numbers": F.concat(F.lit("https://10.0.0.1"), path), "no host": F.concat(F.lit("http://"), path), "query": F.concat(u, F.lit("?q=a.b#c")),
    }
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.explode(F.array(*[F.struct(F.lit(k).alias("form"), v.alias("url")) for k, v in forms.items()])).alias("x"))
    return rows.groupBy("x.form", sources.url_column(F.col("x.url")).alias("is_url")).agg(F.count("*").alias("n"))


def jsonl_roundtrip(spark, sf_dir):
    """Documents with one extraction each, whose attributes are an object, written and read again."""
    path = storage.fresh_path(spark, "jsonl")
    one = F.array(
        F.struct(F.lit("source"), F.col("source"), F.struct(F.lit(0), F.length("source")), F.lit("match_exact"), F.lit(1), F.lit(0), F.lit(None).cast("string"), F.to_json(F.struct("lang", "n_chars")))
    ).cast(f"array<{extraction.EXTRACTION}>")
    sources.write_jsonl(_docs(spark, sf_dir).select(one.alias("extractions"), "text", F.col("doc_id").cast("string").alias("document_id")), path)
    found = sources.read_jsonl(spark, path)
    e = F.get("extractions", F.lit(0))
    return found.select("document_id", F.length("text").cast("bigint").alias("n_chars"), e["extraction_text"].alias("source"), F.get_json_object(e["attributes"], "$.lang").alias("lang"), e["char_interval"]["end_pos"].cast("bigint").alias("end_pos"))


def csv_roundtrip(spark, sf_dir):
    """Documents written as CSV, with their commas, quotes and line breaks, and read again."""
    path = storage.fresh_path(spark, "documents") + ".csv"
    _docs(spark, sf_dir).select("doc_id", "text").write.csv(path, header=True, quote='"', escape='"', quoteAll=True)
    return sources.read_csv(spark, path, "doc_id", "text").select("document_id", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def _spec() -> plan.Spec:
    return plan.Spec(TEMPLATE, inference.Rules(RULES))


def _by_language(spark, sf_dir, spec):
    annotated = plan.extract(_as_documents(spark, sf_dir), spec)
    langs = _docs(spark, sf_dir).select(F.col("doc_id").cast("string").alias("document_id"), "lang")
    rows = annotated.select("document_id", F.explode("extractions").alias("e")).join(langs, "document_id")
    grounded = F.count(F.when(F.col("e.char_interval").isNotNull(), 1))
    return rows.groupBy("lang", F.col("e.extraction_class").alias("extraction_class")).agg(F.count("*").alias("n"), grounded.alias("n_grounded"), F.count_distinct("document_id").alias("n_documents"))


def extract_documents(spark, sf_dir):
    """Flagship: chunk, prompt, infer by rules, parse, ground, assemble; extractions by language and class."""
    return _by_language(spark, sf_dir, _spec())


def extract_whole_documents(spark, sf_dir):
    """The same with whole documents as chunks, so that no boundary cuts what a rule would match."""
    return _by_language(spark, sf_dir, dataclasses.replace(_spec(), max_char_buffer=10_000_000))


def align_status_counts(spark, sf_dir):
    rows = extraction.extraction_rows(plan.resolved(_as_documents(spark, sf_dir), _spec()))
    return rows.groupBy("extraction_class", F.coalesce("alignment_status", F.lit("none")).alias("alignment_status")).agg(F.count("*").alias("n"))


def extraction_summary(spark, sf_dir):
    rows = assemble_docs(spark, sf_dir)
    item = F.struct(F.lit("email"), F.lit("x"), F.struct(F.lit(0), F.lit(1)), *[F.lit(None)] * 5)
    made = F.transform(F.filter(F.split("found", " "), lambda x: x != ""), lambda x: item).cast(f"array<{extraction.EXTRACTION}>")
    return extraction.summary(rows.select(made.alias("extractions"), F.col("found").alias("text"), "document_id"))


def unicode_token_stats(spark, sf_dir):
    rows = documents.tokenized(_docs(spark, sf_dir), "unicode").select("doc_id", F.size("tokens").cast("bigint").alias("n_tokens"))
    return rows


def mixed_script_tokens(spark, sf_dir):
    """Documents with Cyrillic vowels in Latin words, by the Unicode tokenizer, which ends a token where the script changes."""
    rows = _docs(spark, sf_dir).select("doc_id", F.translate("text", "aeouy", "аеоуы").alias("text"))
    found = documents.token_rows(rows, "doc_id", tokenizer="unicode", fields=("token_type", "start_pos", "end_pos"))
    return found.groupBy("doc_id").agg(F.count("*").alias("n_tokens"), F.count(F.when(F.col("token_type") == 0, 1)).alias("n_words"), F.sum("start_pos").alias("sum_start"), F.max(F.col("end_pos") - F.col("start_pos")).cast("bigint").alias("longest"))


def viz_html_len(spark, sf_dir):
    annotated = plan.extract(_as_documents(spark, sf_dir), _spec())
    return annotated.filter(F.size("extractions") > 0).select("document_id", F.length(review.page_column(F.col("text"), F.col("extractions"))).cast("bigint").alias("n_html"))


QUERIES = {
    f.__name__: f
    for f in (
        extract_documents, extract_whole_documents, doc_scan_project, doc_filter_lang, doc_prompt_dedup, token_stats_by_doc, token_type_counts, newline_flags, token_norm_topk, sentence_stats_by_doc, sanitize_text,
        chunk_stats_by_doc, conversation_context, prompt_render_len, batch_assign, fence_extract, json_parse_status, rules_mentions, overlap_pairs, overlap_semi, overlap_anti, interval_overlaps, multipass_merge,
        assemble_docs, attribute_groups, sketch_states, class_share, mention_topk, class_rollup, class_color_index, event_sessions, running_chars, cache_hits, cache_misses, labels_join_quality, benchmark_overlap_docs, url_predicate, jsonl_roundtrip,
        align_status_counts, extraction_summary, unicode_token_stats, mixed_script_tokens, viz_html_len, exact_alignment, cached_answers, cache_new_rows, batch_answers, csv_roundtrip,
    )
}

#: Tokens in DuckDB: characters with a class (0 space, 1 letter, 2 digit, 3 symbol); a token starts where the class
#: changes, or at another symbol.
_TOKENS = r"""
WITH c AS (
  SELECT doc_id, unnest(string_split(text, '')) AS ch, unnest(range(len(string_split(text, '')))) AS pos FROM documents WHERE text <> ''
), k AS (
  SELECT *, CASE WHEN regexp_matches(ch, '^[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]$') THEN 0 WHEN regexp_matches(ch, '^\p{Nd}$') THEN 2 WHEN ch = '_' THEN 3
    WHEN regexp_matches(ch, '^[\p{L}\p{M}\p{Nl}\p{Pc}]$') THEN 1 ELSE 3 END AS cls FROM c
), s AS (
  SELECT *, CASE WHEN lag(cls) OVER w IS DISTINCT FROM cls OR (cls = 3 AND lag(ch) OVER w <> ch) THEN 1 ELSE 0 END AS starts FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY pos)
), g AS (SELECT *, sum(starts) OVER (PARTITION BY doc_id ORDER BY pos) AS seg FROM s),
seg AS (SELECT doc_id, seg, min(pos) AS start_pos, max(pos) + 1 AS end_pos, any_value(cls) AS cls, string_agg(ch, '' ORDER BY pos) AS token FROM g GROUP BY doc_id, seg),
n AS (SELECT *, lag(token) OVER w AS gap, lag(cls) OVER w AS gap_cls, lag(start_pos) OVER w AS gap_start FROM seg WINDOW w AS (PARTITION BY doc_id ORDER BY seg)),
tok AS (
  SELECT doc_id, token, start_pos, end_pos, CASE cls WHEN 1 THEN 0 WHEN 2 THEN 1 ELSE 2 END AS token_type, row_number() OVER (PARTITION BY doc_id ORDER BY seg) - 1 AS idx,
    coalesce(gap_cls = 0 AND gap_start > 0 AND regexp_matches(gap, '[\n\r]'), false) AS broken
  FROM n WHERE cls <> 0
)
"""
#: Sentences (``y``: document, number, first token, end) and the sentence of each token (``z``).
_SENTENCES = (
    _TOKENS.replace("WITH c AS", "WITH RECURSIVE c AS", 1)
    + r""", p AS (
  SELECT *, token_type = 2 AND regexp_matches(token, '[.?!。！？।]["''”’»)\]}]*$') AND coalesce(lag(token) OVER w || token, '') NOT IN ('Mr.', 'Mrs.', 'Ms.', 'Dr.', 'Prof.', 'St.') AS e,
    token IN ('"', '''', '”', '’', '»', ')', ']', '}') AS closer, lead(token) OVER w AS nt, lead(broken) OVER w AS nb FROM tok WINDOW w AS (PARTITION BY doc_id ORDER BY idx)
), q AS (SELECT *, coalesce(last_value(CASE WHEN e OR NOT closer THEN e END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY idx ROWS UNBOUNDED PRECEDING), false) AS st FROM p),
r AS (
  SELECT *, nt IS NULL OR (st AND nt NOT IN ('"', '''', '”', '’', '»', ')', ']', '}')) OR (NOT st AND nb AND NOT (lower(left(nt, 1)) = left(nt, 1) AND upper(left(nt, 1)) <> left(nt, 1))) AS ends FROM q
), z AS (SELECT *, coalesce(sum(CAST(ends AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM r),
y AS (SELECT doc_id, k, min(idx) AS a, max(idx) + 1 AS b FROM z GROUP BY doc_id, k)
"""
)
#: Chunks of at most 1000 characters: whole sentences while they fit; a longer one is cut at its last line start or after the last token that fits.
_CHUNKS = (
    _SENTENCES
    + """, d AS (
  SELECT doc_id, list(start_pos ORDER BY idx) AS heads, list(end_pos ORDER BY idx) AS tails, list(broken ORDER BY idx) AS breaks, list(b ORDER BY idx) AS closes, count(*) AS n FROM z JOIN y USING (doc_id, k) GROUP BY doc_id
), w AS (SELECT doc_id, list(b ORDER BY b) AS closings FROM y GROUP BY doc_id),
f AS (
  SELECT doc_id, CAST(0 AS BIGINT) AS first, CAST(0 AS BIGINT) AS stop, false AS rest, 0 AS number FROM d
  UNION ALL
  SELECT doc_id, here, CASE WHEN NOT one_fits THEN here + 1 WHEN NOT all_fit THEN coalesce(list_max(list_filter(range(here + 1, reach + 1), lambda q: breaks[q + 1])), reach) WHEN rest THEN fin
    ELSE list_max(list_filter(closings, lambda q: q >= fin AND tails[q] - heads[here + 1] <= 1000)) END, CASE WHEN NOT one_fits THEN here + 1 < fin ELSE NOT all_fit END, number + 1
  FROM (
    SELECT *, tails[here + 1] - heads[here + 1] <= 1000 AS one_fits, tails[fin] - heads[here + 1] <= 1000 AS all_fit, here + len(list_filter(tails[here + 1:fin], lambda q: q - heads[here + 1] <= 1000)) AS reach
    FROM (SELECT f.doc_id, f.stop AS here, f.rest, f.number, d.heads, d.tails, d.breaks, CAST(d.closes[f.stop + 1] AS BIGINT) AS fin, w.closings FROM f JOIN d USING (doc_id) JOIN w USING (doc_id) WHERE f.stop < d.n)
  )
)
"""
)
_INTERVALS = "WITH i AS (SELECT l_orderkey, l_linenumber, CAST(l_partkey % 100 AS BIGINT) AS s, CAST(l_partkey % 100 AS BIGINT) + CAST(l_quantity AS BIGINT) AS e FROM lineitem)"
_ON = "a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber AND a.s < b.e AND b.s < a.e"
_CLEAN = r"nullif(regexp_replace(regexp_replace(text, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g'), '[\s\p{Z}]+', ' ', 'g'), '')"
_OUTPUT_SQL = """
WITH b AS (SELECT conv_id, turn, '{"extractions":[{"role":"' || role || '"}]}' AS body FROM conversations), f AS (
  SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 1 WHEN 1 THEN 0 WHEN 2 THEN 2 ELSE 1 END AS n_blocks, CASE turn % 4 WHEN 0 THEN body WHEN 1 THEN body WHEN 2 THEN NULL ELSE 'broken' END AS body FROM b)
"""
_FOUND = "WITH hits AS (" + " UNION ALL ".join(f"SELECT doc_id, lang, '{k}' AS extraction_class, unnest(regexp_extract_all(text, '{v}')) AS hit FROM documents" for k, v in RULES.items()) + ") "
_KEY = """sha256('{"model": "model-1", "settings": {}}' || chr(31) || text)"""
_GRAMS = "SELECT DISTINCT {0}, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT {0}, w, unnest(range(1, len(w) - 6)) AS i FROM (SELECT {0}, string_split(text, ' ') AS w FROM {1}) WHERE len(w) >= 8)"

_BY_CLASS = "SELECT lang, extraction_class, count(*) AS n, count(*) AS n_grounded, count(DISTINCT doc_id) AS n_documents FROM hits GROUP BY ALL"
_IN_CHUNKS = (
    _CHUNKS
    + ", t AS (SELECT doc_id, lang, text[heads[first + 1] + 1:tails[stop]] AS chunk FROM f JOIN d USING (doc_id) JOIN documents USING (doc_id) WHERE number > 0), hits AS ("
    + " UNION ALL ".join(f"SELECT doc_id, lang, '{k}' AS extraction_class, unnest(regexp_extract_all(chunk, '{v}')) AS hit FROM t" for k, v in RULES.items())
    + ") "
)

ORACLE_SQL: dict[str, str] = {
    "extract_documents": _IN_CHUNKS + _BY_CLASS,
    "doc_scan_project": "SELECT doc_id, lang, n_chars FROM documents",
    "doc_filter_lang": "SELECT source, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents WHERE lang = 'de' GROUP BY source",
    "doc_prompt_dedup": "SELECT count(*) AS n, count(DISTINCT text) AS n_distinct FROM documents",
    "token_stats_by_doc": _TOKENS + "SELECT doc_id, count(*) AS n_tokens, CAST(sum(start_pos) AS BIGINT) AS sum_start, max(idx) AS last_index FROM tok GROUP BY doc_id",
    "token_type_counts": _TOKENS + "SELECT CAST(token_type AS INTEGER) AS token_type, count(*) AS n FROM tok GROUP BY token_type",
    "newline_flags": _TOKENS + "SELECT doc_id, count(*) AS n_breaks, CAST(sum(idx) AS BIGINT) AS sum_index FROM tok WHERE broken GROUP BY doc_id",
    "token_norm_topk": _TOKENS
    + ", l AS (SELECT lower(token) AS t FROM tok WHERE token_type = 0) SELECT CASE WHEN length(t) > 3 AND t LIKE '%s' AND t NOT LIKE '%ss' THEN left(t, length(t) - 1) ELSE t END AS token, count(*) AS n "
    "FROM l GROUP BY 1 ORDER BY n DESC, token LIMIT 50",
    "sentence_stats_by_doc": _SENTENCES + "SELECT doc_id, count(*) AS n_sentences, max(b - a) AS longest, CAST(sum(a) AS BIGINT) AS sum_start FROM y GROUP BY doc_id",
    "chunk_stats_by_doc": _CHUNKS + "SELECT CAST(doc_id AS VARCHAR) AS document_id, count(*) AS n_chunks, CAST(max(tails[stop] - heads[first + 1]) AS BIGINT) AS longest, CAST(sum(first) AS BIGINT) AS sum_start FROM f JOIN d USING (doc_id) WHERE number > 0 GROUP BY doc_id",
    "sanitize_text": f"SELECT doc_id, length({_CLEAN}) AS n_clean, sha256({_CLEAN}) AS clean_sha256 FROM documents",
    "conversation_context": "SELECT conv_id, turn, '[Previous text]: ...' || right(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), 30) AS context FROM conversations",
    "prompt_render_len": "SELECT doc_id, length('Find names.' || chr(10) || chr(10) || 'Q: ' || text || chr(10) || 'A: ') AS n_prompt FROM documents",
    "batch_assign": """WITH g AS (SELECT doc_id, n_chars, CAST('0x' || left(md5(CAST(doc_id AS VARCHAR)), 8) AS BIGINT) % 16 AS g FROM documents)
SELECT doc_id, n_chars, g || '-' || ((row_number() OVER (PARTITION BY g ORDER BY doc_id) - 1) // 10) AS batch_id FROM g""",
    "fence_extract": _OUTPUT_SQL + "SELECT conv_id, turn, CAST(n_blocks AS BIGINT) AS n_blocks, body FROM f",
    "json_parse_status": _OUTPUT_SQL + "SELECT CASE WHEN n_blocks > 1 OR body = 'broken' THEN 'not parsed' ELSE 'parsed' END AS status, count(*) AS n, sum(CASE WHEN n_blocks > 1 OR body = 'broken' THEN 0 ELSE 1 END)::BIGINT AS n_items FROM f GROUP BY 1",
    "rules_mentions": f"SELECT * FROM (SELECT doc_id, len(regexp_extract_all(text, '{RULES['email']}')) AS n_mentions, regexp_extract_all(text, '{RULES['email']}')[1] AS first FROM documents) WHERE n_mentions > 0",
    "overlap_pairs": f"{_INTERVALS} SELECT a.l_orderkey, a.l_linenumber AS line_a, b.l_linenumber AS line_b FROM i a JOIN i b ON {_ON}",
    "overlap_semi": f"{_INTERVALS} SELECT a.l_orderkey, a.l_linenumber FROM i a WHERE EXISTS (SELECT 1 FROM i b WHERE {_ON})",
    "overlap_anti": f"{_INTERVALS} SELECT a.l_orderkey, a.l_linenumber FROM i a WHERE NOT EXISTS (SELECT 1 FROM i b WHERE {_ON})",
    "interval_overlaps": """WITH i AS MATERIALIZED (SELECT l_returnflag, l_orderkey, l_linenumber, CAST(l_orderkey AS BIGINT) AS s, CAST(l_orderkey + 1 + l_partkey % 5 + CASE WHEN l_partkey % 100 = 7 THEN 60 ELSE 0 END AS BIGINT) AS e FROM lineitem),
p AS (SELECT *, unnest(range(s - 64, e)) AS t FROM i)
SELECT a.l_returnflag, a.l_orderkey, a.l_linenumber, count(*) AS n FROM p a JOIN i b ON a.l_returnflag = b.l_returnflag AND b.s = a.t WHERE a.s < b.e GROUP BY ALL""",
    "multipass_merge": f"""{_INTERVALS.replace('WITH i', 'WITH RECURSIVE i')}, m AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY s, e) AS n, s, e FROM i), f AS (
  SELECT l_orderkey, 2 AS k, list(m ORDER BY n) FILTER (WHERE n <= 2) AS kept FROM m GROUP BY l_orderkey
  UNION ALL
  SELECT f.l_orderkey, f.k + 1, CASE WHEN len(list_filter(f.kept, lambda y: y.s < m.e AND m.s < y.e)) = 0 THEN list_append(f.kept, m) ELSE f.kept END
  FROM f JOIN m ON m.l_orderkey = f.l_orderkey AND m.n = f.k + 1
) SELECT l_orderkey, array_to_string(list_transform(arg_max(kept, k), lambda x: x.n), ',') AS kept FROM f GROUP BY l_orderkey""",
    "assemble_docs": f"SELECT CAST(doc_id AS VARCHAR) AS document_id, array_to_string(regexp_extract_all(text, '{RULES['email']}'), ' ') AS found FROM documents",
    "attribute_groups": """WITH v AS (SELECT 'language' AS attribute, lang AS value, doc_id, source FROM documents UNION ALL SELECT 'kinds', CASE WHEN n_chars < 500 THEN 'short' WHEN n_chars < 5000 THEN 'middling' ELSE 'long' END, doc_id, source FROM documents
UNION ALL SELECT 'kinds', 'text', doc_id, source FROM documents)
SELECT attribute, value, count(*) AS n, count(DISTINCT doc_id) AS n_documents, count(DISTINCT source) AS n_texts, min(source) AS first_text FROM v GROUP BY attribute, value""",
    "sketch_states": """WITH s AS (SELECT lang, length(source) AS size, count(*) AS c FROM documents GROUP BY lang, length(source))
SELECT lang, CAST(sum(c) AS BIGINT) AS n, true AS distinct_fits, true AS median_fits, max(c) AS top_count FROM s GROUP BY lang""",
    "class_share": "SELECT lang, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM documents GROUP BY lang",
    "mention_topk": "SELECT source, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY source ORDER BY chars DESC, source LIMIT 10",
    "class_rollup": "SELECT lang, source, count(*) AS n FROM documents GROUP BY ROLLUP (lang, source)",
    "class_color_index": "SELECT source AS document_id, lang AS extraction_class, (dense_rank() OVER (PARTITION BY source ORDER BY lang) - 1) % 10 AS color_index FROM (SELECT DISTINCT source, lang FROM documents)",
    "event_sessions": """WITH o AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 12 HOUR THEN 0 ELSE 1 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM o)
SELECT user_id, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS n_errors, min(event_id) AS first_event, date_diff('microsecond', min(ts), max(ts)) AS micros FROM s GROUP BY user_id, k""",
    "running_chars": "SELECT doc_id, CAST(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS chars_so_far FROM documents",
    "cache_hits": f"SELECT doc_id, {_KEY} AS request_key FROM documents WHERE doc_id % 2 = 1 AND text IN (SELECT text FROM documents WHERE doc_id % 2 = 0)",
    "cache_misses": "SELECT doc_id FROM documents WHERE doc_id % 2 = 1 AND text NOT IN (SELECT text FROM documents WHERE doc_id % 2 = 0)",
    "labels_join_quality": "SELECT lang, quality, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang, quality",
    "benchmark_overlap_docs": f"SELECT doc_id, item_id, count(*) AS n_common FROM ({_GRAMS.format('doc_id', 'documents')}) JOIN ({_GRAMS.format('item_id', 'benchmark')}) USING (g) GROUP BY doc_id, item_id",
    "url_predicate": "SELECT unnest(['as it is', 'other scheme', 'no scheme', 'blanks around', 'blank inside', 'no dot', 'local', 'numbers', 'no host', 'query']) AS form, unnest([true, false, false, true, false, false, true, true, false, true]) AS is_url, count(*) AS n FROM pages",
    "jsonl_roundtrip": "SELECT CAST(doc_id AS VARCHAR) AS document_id, length(text) AS n_chars, source, lang, length(source) AS end_pos FROM documents",
    "exact_alignment": """SELECT conv_id, turn, 'role' AS extraction_class, role AS extraction_text, CASE WHEN role IN ('user', 'assistant') THEN 'match_exact' END AS alignment_status,
  CAST(CASE role WHEN 'user' THEN 0 WHEN 'assistant' THEN 9 END AS BIGINT) AS start_pos, CAST(CASE role WHEN 'user' THEN 4 WHEN 'assistant' THEN 18 END AS BIGINT) AS end_pos,
  CAST(CASE role WHEN 'user' THEN 0 WHEN 'assistant' THEN 2 END AS BIGINT) AS start_index FROM conversations WHERE turn % 4 < 2""",
    "extraction_summary": f"""WITH m AS (SELECT regexp_extract_all(text, '{RULES['email']}') AS m FROM documents)
SELECT count(*) AS documents, CAST(sum(length(array_to_string(m, ' '))) AS BIGINT) AS characters, CAST(sum(len(m)) AS BIGINT) AS extractions, CAST(sum(len(m)) AS BIGINT) AS grounded, CAST(1 AS INTEGER) AS classes FROM m""",
    "cached_answers": f"SELECT doc_id, {_KEY} AS request_key, CASE WHEN text IN (SELECT text FROM documents WHERE doc_id % 2 = 0) THEN 'cached' ELSE length(text) || ' characters' END AS output FROM documents",
    "cache_new_rows": f"""WITH k AS (SELECT doc_id, {_KEY} AS request_key, length(text) || ' characters' AS own FROM documents),
e AS (SELECT request_key, count(*) FILTER (WHERE doc_id % 2 = 0) AS n_even, count(*) AS n, any_value(own) AS own FROM k GROUP BY request_key)
SELECT request_key, CASE WHEN n_even > 0 THEN 'cached' ELSE own END AS output, n AS n_documents, greatest(n_even, 1) AS n_rows FROM e""",
    "batch_answers": f"SELECT doc_id, {_KEY} AS request_key, length(text) || ' characters' AS output FROM documents",
    "csv_roundtrip": "SELECT CAST(doc_id AS VARCHAR) AS document_id, sha256(text) AS text_sha256 FROM documents",
    "mixed_script_tokens": _TOKENS.replace("FROM documents", "FROM (SELECT doc_id, translate(text, 'aeouy', 'аеоуы') AS text FROM documents)").replace(r"""WHEN regexp_matches(ch, '^\p{Nd}$') THEN 2 WHEN ch = '_' THEN 3
    WHEN regexp_matches(ch, '^[\p{L}\p{M}\p{Nl}\p{Pc}]$') THEN 1 ELSE 3 END""", r"WHEN regexp_matches(ch, '^\p{N}$') THEN 2 WHEN NOT regexp_matches(ch, '^\p{L}$') THEN 3 WHEN regexp_matches(ch, '^\p{Cyrillic}$') THEN 4 ELSE 1 END").replace("WHEN 1 THEN 0 WHEN 2", "WHEN 1 THEN 0 WHEN 4 THEN 0 WHEN 2")
    + "SELECT doc_id, count(*) AS n_tokens, count(*) FILTER (WHERE token_type = 0) AS n_words, CAST(sum(start_pos) AS BIGINT) AS sum_start, max(end_pos - start_pos) AS longest FROM tok GROUP BY doc_id",
    "unicode_token_stats": _TOKENS + "SELECT doc_id, count(*) AS n_tokens FROM tok GROUP BY doc_id",
    "extract_whole_documents": _FOUND + _BY_CLASS,
}
