"""Prompts, parsing, grounding, merging and assembly of extractions as DataFrames."""

from __future__ import annotations

import json
from itertools import accumulate

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType

from ..functions import alignment, intervals, kernels
from ..functions.formats import Example, Format, Template
from ..functions.kernels import Tokenizer
from ..types import EXTRACTION, FormatError, PromptAlignmentError
from .documents import slices

ITEM = f"struct<ordinal: int, extraction_class: string, extraction_text: string, char_interval: struct<start_pos: int, end_pos: int>, token_interval: struct<start_index: int, end_index: int>, alignment_status: string, extraction_index: int, group_index: int, description: string, attributes: string>"
_SPAN = pa.struct([("start_pos", pa.int32()), ("end_pos", pa.int32())])
_TOKENS = pa.struct([("start_index", pa.int32()), ("end_index", pa.int32())])
_ITEM = pa.struct(
    [("ordinal", pa.int32()), ("extraction_class", pa.string()), ("extraction_text", pa.string()), ("char_interval", _SPAN), ("token_interval", _TOKENS), ("alignment_status", pa.string()),
     ("extraction_index", pa.int32()), ("group_index", pa.int32()), ("description", pa.string()), ("attributes", pa.string())]
)
RESULT = f"struct<items: array<{ITEM}>, parse_error: string, align_error: string>"
_RESULT = pa.struct([("items", pa.list_(_ITEM)), ("parse_error", pa.string()), ("align_error", pa.string())])


def prompted(chunks: DataFrame, template: Template, fmt: Format) -> DataFrame:
    """``chunks`` with ``prompt``: constant parts around the chunk's context and text."""
    before, examples = template.prompt_parts(fmt)
    context = F.when(F.coalesce(F.col("context"), F.lit("")) != "", F.concat(F.col("context"), F.lit("\n\n"))).otherwise("")
    shown = F.lit(examples + "\n" if examples else "")
    return chunks.withColumn("prompt", F.concat(F.lit(before + "\n"), context, shown, F.lit("Q: "), F.col("chunk_text"), F.lit("\nA: ")))


def resolved(inferred: DataFrame, fmt: Format, options: alignment.Options = alignment.Options(), tokenizer: str | Tokenizer = "regex", suppress_parse_errors: bool = True) -> DataFrame:
    """``inferred`` with ``result``: the parsed and grounded extractions of the best output of each chunk.

    Positions are those of the document.  An output that can't be parsed gives no items and
    a ``parse_error`` (or raises, if not suppressed); one that can't be aligned keeps its
    items ungrounded with an ``align_error``.
    """
    tokenize = kernels.tokenizer_of(tokenizer)

    @F.arrow_udf(RESULT)
    def made(chunk: pa.Array, output: pa.Array, token_start: pa.Array, char_start: pa.Array) -> pa.Array:
        parts = [found(own, *(x.slice(first, len(own)) for x in (output, token_start, char_start))) for first, own in slices(chunk)]
        return pa.concat_arrays(parts) if parts else pa.array([], _RESULT)

    def found(chunk: pa.Array, output: pa.Array, token_start: pa.Array, char_start: pa.Array) -> pa.Array:
        rows = []
        for c, o, t, p in zip(chunk.to_pylist(), output.to_pylist(), token_start.to_pylist(), char_start.to_pylist(), strict=True):
            row = {"items": [], "parse_error": None, "align_error": None}
            rows.append(row)
            try:
                items = fmt.ordered(fmt.parse(o))
            except FormatError as e:
                if not suppress_parse_errors:
                    raise
                row["parse_error"] = str(e)
                continue
            if not items:
                continue
            places = [None] * len(items)
            try:
                places = alignment.align(c, [e.extraction_text for e in items], options, tokenize, t, p)
            except ValueError as e:
                row["align_error"] = str(e)
            for k, (e, g) in enumerate(zip(items, places, strict=True)):
                row["items"].append(
                    {"ordinal": k, "extraction_class": e.extraction_class, "extraction_text": e.extraction_text, "extraction_index": e.extraction_index, "group_index": e.group_index, "description": e.description,
                     "attributes": None if e.attributes is None else json.dumps(e.attributes, ensure_ascii=False), "alignment_status": g and g.status,
                     "char_interval": g and {"start_pos": g.char_start, "end_pos": g.char_end}, "token_interval": g and {"start_index": g.token_start, "end_index": g.token_end}}
                )
        return pa.array(rows, _RESULT)

    best = F.get(F.col("outputs"), F.lit(0))["output"]
    return inferred.withColumn("result", made(F.col("chunk_text"), best, F.col("token_start"), F.col("char_start")))


def extraction_rows(resolved_: DataFrame, keys: tuple[str, ...] = ("document_id", "pass", "chunk_index")) -> DataFrame:
    """One row per extraction with its keys; this is the table for analytics."""
    return resolved_.select(*keys, F.inline("result.items"))


def attributes_map(attributes: Column) -> Column:
    """Attributes as a map of text lists; a single value is a list of one."""
    raw = F.from_json(attributes, "map<string,string>")
    return F.transform_values(raw, lambda _, v: F.coalesce(F.from_json(v, "array<string>"), F.array(v)))


def attribute_rows(rows: DataFrame, keys: tuple[str, ...] = ("document_id",)) -> DataFrame:
    """``keys, attribute, value, extraction_class, extraction_text``: a row for each value of each attribute of an extraction.

    An attribute with several values gives several rows; one that an extraction repeats
    gives one.  Extractions without attributes give none.
    """
    pairs = rows.select(*keys, "extraction_class", "extraction_text", F.explode(attributes_map(F.col("attributes"))).alias("attribute", "_values"))
    return pairs.select(*keys, "attribute", F.explode(F.array_distinct("_values")).alias("value"), "extraction_class", "extraction_text")


def attribute_groups(rows: DataFrame, salts: int = 32) -> DataFrame:
    """``attribute, value, n, n_documents, n_texts, first_text`` of ``attribute_rows``: what extractions share a value of an attribute.

    One value may stand on most rows: different documents and texts are found in ``salts``
    parts of each group by hash, and only the parts' numbers are added up, so no task sees
    a whole group.
    """
    part = lambda c: F.pmod(F.xxhash64(c), F.lit(salts))
    keys = ["attribute", "value"]
    tagged = rows.select(*keys, F.explode(F.array(F.struct(F.lit("d").alias("kind"), F.col("document_id").cast("string").alias("x")), F.struct(F.lit("t").alias("kind"), F.col("extraction_text").alias("x")))).alias("e"))
    parts = tagged.select(*keys, "e.kind", "e.x", part("e.x").alias("part"))
    once = parts.groupBy(*keys, "part", "kind", "x").agg(F.count("*").alias("n"))
    by_part = once.groupBy(*keys, "part", "kind").agg(F.sum("n").alias("n"), F.count("x").alias("different"), F.min("x").alias("least"))
    of = lambda kind, c: F.when(F.col("kind") == kind, F.col(c))
    return by_part.groupBy(*keys).agg(F.sum(of("t", "n")).alias("n"), F.sum(of("d", "different")).alias("n_documents"), F.sum(of("t", "different")).alias("n_texts"), F.min(of("t", "least")).alias("first_text"))


@F.arrow_udf(ArrayType(BooleanType()))
def _accepted(first: pa.Array, later: pa.Array) -> pa.Array:
    def spans(lists: pa.Array) -> tuple[list[int], list[tuple]]:
        sizes = [n or 0 for n in pc.list_value_length(lists).to_pylist()]
        return list(accumulate(sizes, initial=0)), list(zip(*(c.to_pylist() for c in lists.flatten().flatten()), strict=True))

    (of_first, firsts), (of_later, laters) = spans(first), spans(later)
    keep: list[bool] = []
    for a, b, c, d in zip(of_first, of_first[1:], of_later, of_later[1:], strict=False):
        keep += intervals.accepted(firsts[a:b], laters[c:d]) if c < d else []
    return pa.ListArray.from_arrays(pa.array(of_later, pa.int32()), pa.array(keep, pa.bool_()))


def merge_passes(first: Column, later: Column) -> Column:
    """Extractions of the first pass, and those of later ones (in order) that overlap none accepted before.

    Extractions without a place never overlap.  What is accepted is kept as a sorted set,
    so a document of n extractions takes n log n looks.
    """
    places = lambda items: F.transform(items, lambda x: F.struct(x["char_interval"]["start_pos"].alias("start_pos"), x["char_interval"]["end_pos"].alias("end_pos")))
    both = F.array(F.struct(first.alias("first"), later.alias("later"), _accepted(places(first), places(later)).alias("keep")))
    return F.get(F.transform(both, lambda x: F.concat(x["first"], F.filter(x["later"], lambda _, k: F.get(x["keep"], k)))), F.lit(0))


def assembled(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """``document_id, text, extractions``: every document with its merged extractions, in order."""
    order = F.struct("pass", "chunk_index", "ordinal", *[c for c in ("extraction_class", "extraction_text", "char_interval", "alignment_status", "extraction_index", "group_index", "description", "attributes")])
    listed = rows.groupBy("document_id").agg(F.array_sort(F.collect_list(order)).alias("all"))
    first, later = F.filter("all", lambda x: x["pass"] == 0), F.filter("all", lambda x: x["pass"] > 0)
    listed = listed.withColumn("merged", merge_passes(first, later))
    kept = F.transform("merged", lambda x: x.dropFields("pass", "chunk_index", "ordinal")).cast(f"array<{EXTRACTION}>")
    joined = docs.select("document_id", "text").join(listed.select("document_id", kept.alias("extractions")), "document_id", "left")
    return joined.withColumn("extractions", F.coalesce("extractions", F.array().cast(f"array<{EXTRACTION}>"))).select("extractions", "text", "document_id")


def summary(annotated: DataFrame, seconds: float | None = None, max_char_buffer: int | None = None) -> DataFrame:
    """One row: documents, characters, extractions, grounded ones, distinct classes.

    With the run's ``seconds`` also characters a second; with the chunks' size also how many
    chunks there were at least.

    Partial counts are made before anything is shuffled; classes are counted as rows.
    """
    grounded = F.filter("extractions", lambda e: e["char_interval"].isNotNull())
    least = F.ceil(F.length("text") / F.lit(max_char_buffer or 1)).cast("bigint").alias("least_chunks")
    sums = F.struct(F.length("text").alias("characters"), F.size("extractions").alias("extractions"), F.size(grounded).alias("grounded"), least)
    rows = annotated.select(sums.alias("s"), F.posexplode_outer(F.transform("extractions", lambda e: e["extraction_class"])).alias("pos", "class"))
    once = F.coalesce(F.col("pos"), F.lit(0)) == 0
    total = lambda c: F.coalesce(F.sum(F.when(once, F.col(c))), F.lit(0))
    more = [(total("s.characters") / F.lit(seconds)).alias("characters_a_second")] if seconds else []
    more += [total("s.least_chunks").alias("least_chunks")] if max_char_buffer else []
    return rows.agg(
        F.count(F.when(once, 1)).alias("documents"),
        total("s.characters").alias("characters"),
        total("s.extractions").alias("extractions"),
        total("s.grounded").alias("grounded"),
        F.count_distinct("class").cast("int").alias("classes"),
        *more,
    )


# -- checks of the examples ------------------------------------------------------------


def example_issues(examples: list[Example], options: alignment.Options = alignment.Options()) -> list[dict]:
    """Extractions of the examples that aren't found in their own text, or not exactly."""
    out = []
    for k, x in enumerate(examples):
        if not x.extractions:
            continue
        places = alignment.align(x.text, [e.extraction_text for e in x.extractions], options)
        for e, g in zip(x.extractions, places, strict=True):
            if g is None or g.status != "match_exact":
                shown = e.extraction_text if len(e.extraction_text) <= 120 else e.extraction_text[:119] + "…"
                out.append({"example_index": k, "extraction_class": e.extraction_class, "extraction_text_preview": shown, "alignment_status": g and g.status, "issue_kind": "failed" if g is None else "non_exact"})
    return out


def check_examples(examples: list[Example], level: str = "warning", strict: bool = False, options: alignment.Options = alignment.Options()) -> list[dict]:
    """``off``, ``warning`` (log) or ``error`` (raise on failed ones; strict: on inexact ones too)."""
    if level not in ("off", "warning", "error"):
        raise ValueError(f"unknown level {level!r}")
    issues = [] if level == "off" else example_issues(examples, options)
    bad = [i for i in issues if strict or i["issue_kind"] == "failed"]
    if level == "error" and bad:
        raise PromptAlignmentError(f"{len(bad)} extractions aren't in their example: {bad[:3]}")
    if issues:
        import logging

        logging.getLogger(__name__).warning("%d example extractions aren't found exactly", len(issues))
    return issues
