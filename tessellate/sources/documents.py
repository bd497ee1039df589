"""Sources and sinks of documents and annotated documents."""

from __future__ import annotations

import ipaddress
from collections.abc import Iterable
from itertools import islice
from urllib.parse import urlsplit

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..types import ANNOTATED_DOCUMENT, STATUSES, InvalidDatasetError, InvalidDocumentError
from . import storage

DOCUMENT = "document_id string, text string, additional_context string"


#: What an extraction in JSON lines may have.
EXTRACTION_KEYS = ("extraction_class", "extraction_text", "char_interval", "alignment_status", "extraction_index", "group_index", "description", "attributes")


def literal(spark: SparkSession, text: str, document_id: str | None = None, context: str | None = None) -> DataFrame:
    """One document; the id is made from the text where none is given."""
    df = spark.createDataFrame([(document_id, text, context)], DOCUMENT)
    return df.withColumn("document_id", F.coalesce("document_id", made_id(F.col("text"))))


def made_id(text: Column) -> Column:
    """A reproducible id: ``doc_`` and 16 hex digits of the text's hash."""
    return F.concat(F.lit("doc_"), F.lower(F.lpad(F.hex(F.xxhash64(F.coalesce(text, F.lit("")))), 16, "0")))


def from_iterable(spark: SparkSession, items: Iterable[str | dict | tuple], rows_a_part: int = 50_000, path: str | None = None) -> DataFrame:
    """Documents of an iterable, in its order of parts, from texts, mappings (``text``, ``document_id``, ``additional_context``) or tuples (id, text[, context]).

    The driver holds ``rows_a_part`` items at a time: each part is written to shared
    storage before the next is drawn, so an iterable may be longer than the memory.  Ids
    are made from the texts where none are given.  No items give an empty table.
    """
    path, parts = path or storage.fresh_path(spark, "documents"), 0

    def row(item: str | dict | tuple) -> tuple:
        if isinstance(item, str):
            return None, item, None
        if isinstance(item, dict):
            if odd := set(item) - {"text", "document_id", "additional_context"}:
                raise InvalidDocumentError(f"unknown keys of a document: {sorted(odd)}")
            return item.get("document_id"), item["text"], item.get("additional_context")
        return (*item, None)[:3]

    items = iter(items)
    while held := [row(x) for x in islice(items, rows_a_part)]:
        df = spark.createDataFrame(held, DOCUMENT)
        df.withColumn("document_id", F.coalesce("document_id", made_id(F.col("text")))).write.mode("overwrite").parquet(f"{path}/part={parts:06d}")
        parts += 1
    if not parts:
        return spark.createDataFrame([], DOCUMENT)
    return spark.read.schema(DOCUMENT).parquet(*[f"{path}/part={k:06d}" for k in range(parts)])


def from_table(df: DataFrame, id_col: str, text_col: str, context: str | None = None) -> DataFrame:
    """Documents of any table; ``context`` fills in where the table has no context of its own."""
    own = F.col("additional_context") if "additional_context" in df.columns else F.lit(None).cast("string")
    return df.select(F.col(id_col).cast("string").alias("document_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(own, F.lit(context)).alias("additional_context"))


def read_csv(spark: SparkSession, path: str, id_key: str, text_key: str, delimiter: str = ",") -> DataFrame:
    """Id and text of a CSV file with a header; an empty cell is an empty text.

    A missing file is an ``OSError``, one without a header or a wanted column an
    ``InvalidDatasetError``.
    """
    if not path.lower().endswith(".csv"):
        raise NotImplementedError(f"not a .csv path: {path}")
    if not any(c in path for c in "*?[{") and not storage.exists(spark, path):
        raise FileNotFoundError(f"no such file: {path}")
    if spark.read.text(path).limit(1).isEmpty():
        raise InvalidDatasetError(f"{path} is empty")
    df = spark.read.csv(path, header=True, sep=delimiter, multiLine=True, quote='"', escape='"')
    if missing := {id_key, text_key} - set(df.columns):
        raise InvalidDatasetError(f"{path} lacks the columns {sorted(missing)}")
    return from_table(df.select(id_key, text_key), id_key, text_key)


def require_unique_ids(docs: DataFrame) -> DataFrame:
    """``docs``; raises if an id is empty or repeats (one aggregation with early partial counts)."""
    bad = docs.groupBy("document_id").count().filter((F.col("count") > 1) | F.col("document_id").isNull() | (F.col("document_id") == "")).take(1)
    if bad:
        raise InvalidDocumentError(f"document id {bad[0][0]!r} is empty or occurs {bad[0][1]} times")
    return docs


def write_jsonl(annotated: DataFrame, path: str, single_file: bool = False) -> None:
    """One JSON object a line: extractions, text, document_id, with explicit nulls; attributes are objects.

    Raises if a document has no id (nothing is committed then) or if there is no document.
    The plan runs once: ids are checked while their lines are made.
    """
    whole = F.transform("extractions", lambda e: e.withField("attributes", F.parse_json(e["attributes"])))
    known = F.when(F.coalesce(F.col("document_id"), F.lit("")) == "", F.raise_error(F.lit("a document has no id")).cast("string")).otherwise(F.col("document_id"))
    lines = annotated.select(F.to_json(F.struct(whole.alias("extractions"), "text", known.alias("document_id")), {"ignoreNullFields": "false"}).alias("value"))
    try:
        (lines.coalesce(1) if single_file else lines).write.text(path)
    except Exception as e:
        if "a document has no id" in str(e):
            raise InvalidDocumentError("a document has no id") from e
        raise
    if annotated.sparkSession.read.text(path).isEmpty():
        raise InvalidDatasetError("no documents to write")


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Annotated documents of JSON lines; blank lines are skipped, broken lines and unknown statuses raise.

    Attributes come as the text of their object (its keys in order of their names).
    """
    schema = T.StructType.fromDDL(ANNOTATED_DOCUMENT.replace("attributes: string", "attributes: variant"))
    lines = spark.read.text(path).filter(F.trim("value") != "")
    keys = F.flatten(F.transform(F.from_json("value", "extractions array<map<string, variant>>")["extractions"], lambda e: F.map_keys(e)))
    odd = F.coalesce(F.array_except(keys, F.array(*[F.lit(k) for k in EXTRACTION_KEYS])), F.array().cast("array<string>"))
    parsed = lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("d"), odd.alias("_odd")).select("d.*", "_odd")
    parsed = parsed.withColumn("extractions", F.transform("extractions", lambda e: e.withField("attributes", F.when(F.to_json(e["attributes"]) != "null", F.to_json(e["attributes"])))))
    known = F.forall(F.coalesce("extractions", F.array()), lambda e: e["alignment_status"].isNull() | e["alignment_status"].isin(*STATUSES))
    text = F.when(~known, F.raise_error(F.lit("unknown alignment status")).cast("string")).when(F.size("_odd") > 0, F.raise_error(F.concat(F.lit("unknown keys of an extraction: "), F.array_join("_odd", ", "))).cast("string")).otherwise(F.col("text"))
    return parsed.withColumn("text", text).drop("_odd")


def is_url(text: str) -> bool:
    """An http(s) address without inner white space whose host is an IP, ``localhost``, or has a dot."""
    text = text.strip()
    if any(c in text for c in " \n\r\t"):
        return False
    try:
        parts = urlsplit(text)
        host = parts.hostname
    except ValueError:
        return False
    if parts.scheme not in ("http", "https") or not parts.netloc or not host:
        return False
    try:
        ipaddress.ip_address(host)
        return True
    except ValueError:
        return host == "localhost" or "." in host.strip(".")


def url_column(text: Column) -> Column:
    """:func:`is_url` as an expression (addresses with an IPv6 host included)."""
    t = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    return ~t.rlike(r"[ \n\r\t]") & t.rlike(r"^https?://([^/@?#]*@)?(localhost|\[[0-9A-Fa-f:.]+\]|[^/:?#.]+(\.[^/:?#.]+)+)\.?(:[0-9]*)?([/?#]|$)")


def download(url: str, timeout: float = 30.0, chunk: int = 8192) -> str:
    """Text of an address; for drivers only, never called unless asked for.  UTF-8, else Latin-1."""
    if not is_url(url):
        raise InvalidDatasetError(f"not an address: {url!r}")
    from urllib.request import urlopen

    with urlopen(url, timeout=timeout) as response:  # noqa: S310
        data = b"".join(iter(lambda: response.read(chunk), b""))
    try:
        return data.decode()
    except UnicodeDecodeError:
        return data.decode("latin-1")
