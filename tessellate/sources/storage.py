"""Tables and small files in the storage that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Temporary folders of single machines, by application.
_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only a single machine may do without, and gets a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    application = spark.sparkContext.applicationId
    if application not in _LOCAL:
        _LOCAL[application] = tempfile.mkdtemp(prefix="tessellate-")
    return _LOCAL[application]


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialized(df: DataFrame, path: str) -> DataFrame:
    """``df`` written once and read again, so that whatever uses it twice doesn't compute it twice."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _found(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, files = _found(spark, path)
    return files.exists(at)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names of what a folder has, hidden ones left out; none if there is no such folder."""
    at, files = _found(spark, path)
    if not files.exists(at):
        return []
    return sorted(n for s in files.listStatus(at) if not (n := s.getPath().getName()).startswith(("_", ".")))


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, whole or not at all: it is written beside its place and then renamed."""
    at, files = _found(spark, path)
    beside = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path.rpartition('/')[0]}/_{uuid.uuid4().hex}")
    out = files.create(beside, False)
    out.write(bytearray(text.encode()))
    out.close()
    files.delete(at, False)
    if not files.rename(beside, at):
        raise OSError(f"{path} can't be written")


def get_text(spark: SparkSession, path: str) -> str | None:
    """What a small file holds; null if there is none."""
    at, files = _found(spark, path)
    if not files.exists(at):
        return None
    stream = files.open(at)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()
