"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellate.operators.documents import slices
from tessellate.sources.storage import shared_dir


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Select ``internal=name`` columns by exact name and position.

    Works even if the input carries further columns whose names differ from the wanted
    ones only by case (a plain ``df[name]`` would then be ambiguous), or repeat them: the
    first column of the exact name is taken and all others are left out.
    """
    names = df.columns
    by_position = df.toDF(*[f"_{i}" for i in range(len(names))])
    return by_position.select(*[F.col(f"_{names.index(n)}").alias(k) for k, n in columns.items()])


def numbered(df: DataFrame, *names: str) -> tuple[DataFrame, list[Column]]:
    """``df`` with its columns named by place, so that none clash, and those of ``names``."""
    return df.toDF(*[f"_{i}" for i in range(len(df.columns))]), [F.col(f"_{df.columns.index(n)}") for n in names]


#: Spark's switch for deleting a query's shuffle files as soon as it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Size of a dictionary page in columns of repeated 64-bit hashes; beyond it they are stored plain.
DICTIONARY_BYTES = 8 << 20


@contextmanager
def _cleaned(spark: SparkSession) -> Iterator[None]:
    """Queries that end in here leave no shuffle files behind."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def written_at(df: DataFrame, name: str, partition_by: str | None = None) -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet in the shared folder and read it again; also its path, for :func:`forgotten`.

    Cuts the lineage: an executor lost later costs a re-read, not a recomputation, and a
    column-pruned reader touches only what it needs.  Its shuffle files go at once, so the
    disk holds those of one step at a time.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessellate-{name}-{uuid.uuid4().hex}"
    with _cleaned(spark):
        df.write.parquet(path, partitionBy=partition_by)
    return spark.read.schema(df.schema).parquet(path), path


def written(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """:func:`written_at`, for a table that stays."""
    return written_at(df, name, partition_by)[0]


def forgotten(spark: SparkSession, path: str) -> None:
    """Delete a table in the shared folder that nothing will read any more."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def bucketed_at(df: DataFrame, name: str, keys: list[str]) -> tuple[DataFrame, str]:
    """Like :func:`written_at`, dealt into buckets by ``keys``: joins on all of them don't shuffle it.

    The catalog's entry goes again at once; the files stay in the shared folder.
    """
    spark = df.sparkSession
    made = f"tessellate_{name.replace('-', '_')}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{made}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with _cleaned(spark):
        writer = df.write.format("parquet").bucketBy(buckets, *keys).option("path", path).option("parquet.dictionary.page.size", DICTIONARY_BYTES).option("compression", "zstd")
        writer.saveAsTable(made)
    found = spark.table(made)
    found.schema  # resolved now, so the entry isn't needed later
    spark.sql(f"DROP TABLE {made}")
    return found, path


def bucketed(df: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """:func:`bucketed_at`, for a table that stays."""
    return bucketed_at(df, name, keys)[0]


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """True where crc32 of the id as text, modulo ``folds``, is ``fold`` (null ids: False)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def masked(docs: DataFrame, text_col: str, decider: Callable[[], Callable[[list[str]], list[bool]]]) -> DataFrame:
    """The rows of ``docs`` whose text (null: empty) is accepted; all columns pass through.

    ``decider`` is called once in a task and gives the function that decides on some texts.
    It gets slices of an Arrow batch, so a task holds Python strings and kept rows of some
    texts only, however many rows a batch has.
    """
    at, (plain, _) = docs.columns.index(text_col), numbered(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decide = decider()
        for batch in batches:
            for first, texts in slices(batch.column(at)):
                kept = decide([t or "" for t in texts.to_pylist()])
                yield batch.slice(first, len(texts)).filter(pa.array(kept, pa.bool_()))

    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
