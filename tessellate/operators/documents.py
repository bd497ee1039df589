"""Tokens, sentences, chunks and batches of documents as DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

from ..functions import kernels
from ..functions.kernels import Tokenizer
from ..functions.tokens import Tokens, simple

#: Fields of token, sentence and chunk rows, with their types.
TOKEN_FIELDS = {"index": "int", "token": "string", "token_type": "int", "start_pos": "int", "end_pos": "int", "first_token_after_newline": "boolean"}
SENTENCE_FIELDS = {"sentence_index": "int", "token_start": "int", "token_end": "int", "char_start": "int", "char_end": "int"}
CHUNK_FIELDS = {"chunk_index": "int", "token_start": "int", "token_end": "int", "char_start": "int", "char_end": "int", "chunk_text": "string"}
#: The end of the chunk before, where chunks are asked for it.
PREVIOUS = {"previous": "string"}
#: Characters that are worked on at once; a longer text is alone.
TOGETHER = 1 << 18
SPARK = {"int": IntegerType(), "string": StringType(), "boolean": BooleanType()}
_ARROW = {"int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
#: Columns of rows by field, and for each row the number of its text.
Found = tuple[np.ndarray, dict[str, Callable[[], pa.Array]]]


def slices(texts: pa.Array, most: int = TOGETHER) -> Iterator[tuple[int, pa.Array]]:
    """Runs of an array's strings of about ``most`` bytes, with the number of the first; a longer string is alone.

    A batch may have thousands of long texts, so nothing is made of all of it at once.
    """
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    first, done = 0, 0
    while first < len(texts):
        stop = max(first + 1, int(np.searchsorted(ends, done + most, "right")))
        yield first, texts.slice(first, stop - first)
        first, done = stop, int(ends[stop - 1])


def _numbers(of: np.ndarray) -> np.ndarray:
    """0, 1, 2 ... within each run of equal numbers."""
    starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else of
    return np.arange(len(of)) - np.repeat(starts, np.diff(np.r_[starts, len(of)]))


def _of_tuples(texts: list[str], rows: Callable[[str], list[tuple]], names: list[str], fields: dict[str, str]) -> Found:
    """Rows that a function makes of each text, for tokenizers that know single texts only."""
    made = [rows(t) for t in texts]
    columns = dict(zip(names, zip(*(r for x in made for r in x), strict=True), strict=True)) if any(made) else {n: () for n in names}
    return np.repeat(np.arange(len(texts)), [len(x) for x in made]), {n: lambda n=n: pa.array(columns[n], _ARROW[fields[n]]) for n in names}


def _ints(values: np.ndarray) -> Callable[[], pa.Array]:
    return lambda: pa.array(values.astype(np.int32))


def _spans(tokens: Tokens, starts: np.ndarray, ends: np.ndarray, number: str) -> Found:
    """Rows of token intervals."""
    of = tokens.text_of()[starts]
    first, at = tokens.first[of], tokens.at[of]
    head, tail = tokens.start[starts] - at, tokens.end[ends - 1] - at
    return of, {number: _ints(_numbers(of)), "token_start": _ints(starts - first), "token_end": _ints(ends - first), "char_start": _ints(head), "char_end": _ints(tail)}


def _by_arrays(texts: list[str], tokenizer: str | Tokenizer) -> Iterator[tuple[int, list[str], bool]]:
    """Runs of texts with the number of the first, and whether they can be worked on as arrays: all but own tokenizers and, by ``unicode``, texts with clusters."""
    if tokenizer == "regex":
        yield 0, texts, True
        return
    flags = [tokenizer == "unicode" and simple(t) for t in texts]
    first = 0
    for k in range(1, len(texts) + 1):
        if k == len(texts) or flags[k] != flags[first]:
            yield first, texts[first:k], flags[first]
            first = k


def _found(texts: list[str], tokenizer: str | Tokenizer, fields: dict[str, str], arrays: Callable[[Tokens, list[str]], Found], single: Callable[[str, list], list[tuple]]) -> Found:
    """Rows of ``texts``, by arrays where possible, else text by text."""
    parts = []
    for first, own, fast in _by_arrays(texts, tokenizer) if texts else ():
        if fast:
            of, columns = arrays(Tokens(own, tokenizer == "unicode"), own)
        else:
            tokenize = kernels.tokenizer_of(tokenizer)
            of, columns = _of_tuples(own, lambda x, t=tokenize: single(x, t(x)), list(fields), fields)
        parts.append((of + first, columns))
    if len(parts) == 1:
        return parts[0]
    none = {n: (lambda k=k: pa.array([], _ARROW[k])) for n, k in fields.items()}
    return np.concatenate([np.zeros(0, np.int64), *(of for of, _ in parts)]), {n: (lambda n=n: pa.concat_arrays([c[n]() for _, c in parts])) if parts else none[n] for n in fields}


def _token_rows(texts: list[str], tokenizer: str | Tokenizer) -> Found:
    def arrays(tokens: Tokens, _) -> Found:
        of = tokens.text_of()
        at = tokens.at[of]
        columns = {"index": _ints(np.arange(len(of)) - tokens.first[of]), "token": tokens.strings, "token_type": _ints(tokens.kind), "start_pos": _ints(tokens.start - at), "end_pos": _ints(tokens.end - at)}
        return of, columns | {"first_token_after_newline": lambda: pa.array(tokens.broken)}

    return _found(texts, tokenizer, TOKEN_FIELDS, arrays, lambda x, tokens: [(k, x[t[1] : t[2]], *t) for k, t in enumerate(tokens)])


def _sentence_rows(texts: list[str], tokenizer: str | Tokenizer) -> Found:
    single = lambda x, tokens: [(k, a, b, tokens[a][1], tokens[b - 1][2]) for k, (a, b) in enumerate(kernels.sentences(x, tokens))]
    return _found(texts, tokenizer, SENTENCE_FIELDS, lambda tokens, _: _spans(tokens, *tokens.sentences(), "sentence_index"), single)


def _chunk_rows(texts: list[str], tokenizer: str | Tokenizer, most: int, before: int = 0) -> Found:
    fields = {n: k for n, k in CHUNK_FIELDS.items() if n != "chunk_text"}
    single = lambda x, tokens: [(k, a, b, tokens[a][1], tokens[b - 1][2]) for k, (a, b) in enumerate(kernels.chunks(x, tokens, most))]
    of, columns = _found(texts, tokenizer, fields, lambda tokens, _: _spans(tokens, *tokens.chunks(most), "chunk_index"), single)

    def cut() -> list[str]:
        heads, tails = columns["char_start"]().to_pylist(), columns["char_end"]().to_pylist()
        return [texts[d][a:b] for d, a, b in zip(of.tolist(), heads, tails, strict=True)]

    def previous() -> pa.Array:
        own = of.tolist()
        return pa.array([t[-before:] if d == e else None for t, d, e in zip([None, *cut()], [None, *own], own, strict=False)], pa.string())

    return of, columns | {"chunk_text": lambda: pa.array(cut(), pa.string()), "previous": previous}


def _rows(docs: DataFrame, kept: list[str], text_col: str, made: Callable[[list[str]], Found], fields: dict[str, str]) -> DataFrame:
    """A row for each thing that ``made`` finds in a text, with the document's ``kept`` columns and ``fields``; nothing else is made."""
    shown = docs.select(*[F.col(c) for c in kept], F.col(text_col).alias("_text"))
    schema = StructType(shown.schema.fields[:-1] + [StructField(n, SPARK[k]) for n, k in fields.items()])
    names = [*kept, *fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = batch.columns[:-1]
            for first, texts in slices(batch.column(len(kept))):
                of, found = made([t or "" for t in texts.to_pylist()])
                at = pa.array(of + first)
                yield pa.RecordBatch.from_arrays([c.take(at) for c in columns] + [found[n]() for n in fields], names)

    return shown.mapInArrow(run, schema)


def _chosen(fields: tuple[str, ...] | None, known: dict[str, str]) -> dict[str, str]:
    return known if fields is None else {n: known[n] for n in fields}


def tokenized(docs: DataFrame, tokenizer: str | Tokenizer = "regex", text_col: str = "text") -> DataFrame:
    """``docs`` with ``tokens``: an array of token structs by any tokenizer; a null text has none.

    Rows pass in slices, so a task holds the tokens of some texts only, however many rows an Arrow batch has.
    """
    names, columns = [n for n in TOKEN_FIELDS if n != "token"], [*docs.columns, "tokens"]
    schema = StructType([*docs.schema.fields, StructField("tokens", ArrayType(StructType([StructField(n, SPARK[TOKEN_FIELDS[n]]) for n in names])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in slices(batch.column("_text")):
                of, found = _token_rows([t or "" for t in texts.to_pylist()], tokenizer)
                ends = np.r_[0, np.cumsum(np.bincount(of, minlength=len(texts)))].astype(np.int32)
                tokens = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([found[n]() for n in names], names))
                yield pa.RecordBatch.from_arrays([*batch.slice(first, len(texts)).columns[:-1], tokens], columns)

    return docs.select("*", F.col(text_col).alias("_text")).mapInArrow(run, schema)


def token_rows(docs: DataFrame, id_col: str = "document_id", text_col: str = "text", tokenizer: str | Tokenizer = "regex", fields: tuple[str, ...] | None = None) -> DataFrame:
    """One row per token: the id and ``fields`` (all of :data:`TOKEN_FIELDS`: index, token, type, offsets, line-break flag).

    Documents stay in their tasks, so nothing is shuffled or sorted; a document without
    tokens has no row.
    """
    return _rows(docs, [id_col], text_col, lambda texts: _token_rows(texts, tokenizer), _chosen(fields, TOKEN_FIELDS))


def sentence_rows(docs: DataFrame, id_col: str = "document_id", text_col: str = "text", tokenizer: str | Tokenizer = "regex", fields: tuple[str, ...] | None = None) -> DataFrame:
    """One row per sentence: the id and ``fields`` (all: number, token interval, character interval); nothing is shuffled."""
    return _rows(docs, [id_col], text_col, lambda texts: _sentence_rows(texts, tokenizer), _chosen(fields, SENTENCE_FIELDS))


def chunked(docs: DataFrame, max_chars: int = 1000, tokenizer: str | Tokenizer = "regex", text_col: str = "text", fields: tuple[str, ...] | None = None, previous: int | None = None) -> DataFrame:
    """One row per chunk: the columns of ``docs`` besides the text, and ``fields`` (all: number, intervals, the chunk's text).

    With ``previous`` also that many characters of the end of the document's chunk before.

    A document without tokens has no chunk.  Documents are worked on apart, so no shuffle
    is needed; the only skew is one document's length.
    """
    others = [c for c in docs.columns if c != text_col]
    wanted = _chosen(fields, CHUNK_FIELDS) | (PREVIOUS if previous else {})
    return _rows(docs, others, text_col, lambda texts: _chunk_rows(texts, tokenizer, max_chars, previous or 0), wanted)


def in_context(chunks: DataFrame) -> DataFrame:
    """``context`` of chunks: the end of the chunk before (``previous``, if there is such a column), and the document's own context below it."""
    own = F.nullif(F.col("additional_context"), F.lit("")) if "additional_context" in chunks.columns else F.lit(None).cast("string")
    if "previous" not in chunks.columns:
        return chunks.withColumn("context", own)
    tail = F.concat(F.lit("[Previous text]: ..."), F.col("previous"))
    return chunks.withColumn("context", F.nullif(F.concat_ws("\n\n", tail, own), F.lit(""))).drop("previous")


def with_previous(chunks: DataFrame, chars: int | None, id_col: str = "document_id") -> DataFrame:
    """``context`` for chunks that are rows of a table; :func:`chunked` knows the chunk before without this window."""
    if not chars:
        return in_context(chunks)
    before = F.lag("chunk_text").over(Window.partitionBy(id_col).orderBy("chunk_index"))
    return in_context(chunks.withColumn("previous", F.right(before, F.lit(chars))))


def batched(chunks: DataFrame, size: int, order: tuple[str, ...] = ("document_id", "chunk_index"), groups: int = 4096) -> DataFrame:
    """``batch_id``: batches of ``size`` rows within each of ``groups`` groups of documents.

    Batches may span documents.  A batch never needs rows of another group, so the window
    has as many partitions as there are groups; the last batch of a group may be short.
    """
    group = F.pmod(F.conv(F.substring(F.md5(F.col(order[0]).cast("string").cast("binary")), 1, 8), 16, 10).cast("bigint"), F.lit(groups))
    n = F.row_number().over(Window.partitionBy("_group").orderBy(*order))
    rows = chunks.withColumn("_group", group).withColumn("_n", F.floor((n - 1) / size))
    return rows.withColumn("batch_id", F.concat_ws("-", "_group", "_n")).drop("_group", "_n")


def batches(rows: Iterator, size: int) -> Iterator[list]:
    """Lists of ``size`` rows of an iterator; the last may be short."""
    held: list = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held
