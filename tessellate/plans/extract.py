"""The extraction plan: documents to grounded extractions, one lazy DataFrame up to inference."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.alignment import Options
from ..functions.formats import Format, Template
from ..functions.kernels import Tokenizer
from ..operators import documents, extraction, inference
from ..sources.documents import from_table, literal
from ..sources.storage import fresh_path, materialized


@dataclass
class Spec:
    """What to extract, and how."""

    template: Template
    provider: inference.Provider
    max_char_buffer: int = 1000
    batch_length: int = 10
    max_workers: int = 10
    passes: int = 1
    context_window_chars: int | None = None
    kind: str = "json"
    fences: bool | None = None
    alignment: Options = field(default_factory=Options)
    tokenizer: str | Tokenizer = "regex"
    suppress_parse_errors: bool = True
    prompt_validation: str = "warning"
    prompt_validation_strict: bool = False
    format_options: dict = field(default_factory=dict)

    def format(self) -> Format:
        return inference.format_for(self.provider, self.kind, self.fences, **self.format_options)


def prompts(docs: DataFrame, spec: Spec) -> DataFrame:
    """Chunks with context and prompt, one row for each chunk and pass; passes don't wait for each other."""
    chunks = documents.in_context(documents.chunked(docs, spec.max_char_buffer, spec.tokenizer, previous=spec.context_window_chars))
    passes = F.explode(F.sequence(F.lit(0), F.lit(spec.passes - 1))).alias("pass")
    return extraction.prompted(chunks, spec.template, spec.format()).select("*", passes)


def resolved(docs: DataFrame, spec: Spec) -> DataFrame:
    """All chunks with their parsed and grounded extractions; nothing is written."""
    asked = inference.infer(prompts(docs, spec), spec.provider, batch=spec.batch_length, max_workers=spec.max_workers)
    return extraction.resolved(asked, spec.format(), spec.alignment, spec.tokenizer, spec.suppress_parse_errors)


def extract(docs: DataFrame, spec: Spec, answers_path: str | None = None, answered: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Annotated documents ``(extractions, text, document_id)`` of ``docs``.

    Answers are written once (to ``answers_path`` or the shared folder) before anything
    reads them, so no failure later asks the provider again.  ``answered`` adds ``outputs``
    to prompts in another way: by batch jobs (``BatchRun.infer``) or a cache
    (``AnswerCache.ask``).
    """
    extraction.check_examples(spec.template.examples, spec.prompt_validation, spec.prompt_validation_strict, spec.alignment)
    shown = prompts(docs, spec)
    asked = answered(shown) if answered else inference.infer(shown, spec.provider, batch=spec.batch_length, max_workers=spec.max_workers)
    answers = materialized(asked, answers_path or fresh_path(docs.sparkSession, "answers"))
    found = extraction.resolved(answers, spec.format(), spec.alignment, spec.tokenizer, spec.suppress_parse_errors)
    return extraction.assembled(docs, extraction.extraction_rows(found))


def extract_text(spark: SparkSession, text: str, spec: Spec) -> DataFrame:
    """The annotated document of one text."""
    return extract(literal(spark, text), spec)


__all__ = ["Spec", "extract", "extract_text", "from_table", "prompts", "resolved"]
