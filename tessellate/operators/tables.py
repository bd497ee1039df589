"""Tokens, sentences and chunks as table functions for SQL."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from . import documents


def _schema(fields: dict[str, str]) -> AnalyzeResult:
    return AnalyzeResult(StructType([StructField(n, documents.SPARK[k]) for n, k in fields.items()]))


def _constant(name: str, given: AnalyzeArgument | None, default):
    if given is not None and (not given.isConstantExpression or given.value is None):
        raise ValueError(f"{name} must be a constant")
    return default if given is None else given.value


def _checked(text: AnalyzeArgument, tokenizer: AnalyzeArgument | None) -> None:
    if text.dataType.typeName() not in ("string", "void"):
        raise ValueError(f"the text is no string but {text.dataType.simpleString()}")
    documents.kernels.tokenizer_of(_constant("tokenizer", tokenizer, "regex"))


def _tuples(found: documents.Found, fields: dict[str, str]) -> Iterator[tuple]:
    yield from zip(*(found[1][n]().to_pylist() for n in fields), strict=True)


@udtf
class TokensOf:
    """``tokens(text [, tokenizer])``."""

    @staticmethod
    def analyze(text: AnalyzeArgument, tokenizer: AnalyzeArgument | None = None) -> AnalyzeResult:
        _checked(text, tokenizer)
        return _schema(documents.TOKEN_FIELDS)

    def eval(self, text, tokenizer="regex"):
        yield from _tuples(documents._token_rows([text or ""], tokenizer), documents.TOKEN_FIELDS)


@udtf
class SentencesOf:
    """``sentences(text [, tokenizer])``."""

    @staticmethod
    def analyze(text: AnalyzeArgument, tokenizer: AnalyzeArgument | None = None) -> AnalyzeResult:
        _checked(text, tokenizer)
        return _schema(documents.SENTENCE_FIELDS)

    def eval(self, text, tokenizer="regex"):
        yield from _tuples(documents._sentence_rows([text or ""], tokenizer), documents.SENTENCE_FIELDS)


@udtf
class ChunksOf:
    """``chunks(text, max_chars [, tokenizer])``."""

    @staticmethod
    def analyze(text: AnalyzeArgument, max_chars: AnalyzeArgument, tokenizer: AnalyzeArgument | None = None) -> AnalyzeResult:
        _checked(text, tokenizer)
        if _constant("max_chars", max_chars, 0) < 1:
            raise ValueError("max_chars is at least 1")
        return _schema(documents.CHUNK_FIELDS)

    def eval(self, text, max_chars, tokenizer="regex"):
        yield from _tuples(documents._chunk_rows([text or ""], tokenizer, max_chars), documents.CHUNK_FIELDS)


def register(spark: SparkSession) -> None:
    """``tokens``, ``sentences`` and ``chunks`` for ``LATERAL`` joins in SQL; the rows are those of the DataFrame operators."""
    for name, function in (("tokens", TokensOf), ("sentences", SentencesOf), ("chunks", ChunksOf)):
        spark.udtf.register(name, function)
