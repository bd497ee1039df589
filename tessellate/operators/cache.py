"""Answers kept by request: a table in shared storage to which every answer is added once."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import storage
from .inference import OUTPUTS, Provider, infer, request_key

#: Hexadecimal digits of a key by which the table is dealt into folders.
PREFIX = 2


def prefix_of(key: Column) -> Column:
    return F.substring(key, 1, PREFIX)


class AnswerCache:
    """Outputs by ``request_key`` below ``path``, in a folder for each run and key prefix.

    Rows are only ever added, each run to a folder of its own, so a run that is broken off
    spoils nothing, and what it has finished is found by the next.  Runs at the same time
    may both answer a request; the first in order of the runs' names then counts, so a
    key never has two answers.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def rows(self) -> DataFrame:
        """All rows as they were added: ``request_key, outputs, run, prefix``."""
        schema = f"request_key string, outputs {OUTPUTS}, run string, prefix string"
        if not storage.names(self.spark, self.path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self.path)

    def of(self, keys: DataFrame) -> DataFrame:
        """``request_key, outputs`` of those of the distinct ``keys`` (``request_key``) that have an answer."""
        wanted = keys.select("request_key", prefix_of(F.col("request_key")).alias("prefix"))
        found = self.rows().join(wanted, ["prefix", "request_key"])
        return found.groupBy("request_key").agg(F.min_by("outputs", "run").alias("outputs"))

    def add(self, answers: DataFrame, run: str | None = None) -> str:
        """Adds ``answers (request_key, outputs)``; returns the new folder's name."""
        run = run or uuid.uuid4().hex
        rows = answers.select("request_key", "outputs", prefix_of(F.col("request_key")).alias("prefix"))
        rows.write.partitionBy("prefix").mode("errorifexists").parquet(f"{self.path}/run={run}")
        return run

    def ask(self, prompts: DataFrame, provider: Provider, model_id: str, settings: dict | None = None, prompt_col: str = "prompt", blocks: int = 1, **kwargs) -> DataFrame:
        """``prompts`` with ``request_key`` and ``outputs``; only requests without an answer are asked, each once.

        New answers are on disk before anything reads them.  ``blocks`` deals the requests
        into as many jobs by key, each of which is safe when it ends: a run that is broken
        off and started again asks at most one block's requests a second time.
        """
        keyed = prompts.withColumn("request_key", request_key(F.col(prompt_col), model_id, settings))
        wanted = keyed.groupBy("request_key").agg(F.min(prompt_col).alias("prompt"))
        block = F.pmod(F.xxhash64("request_key"), F.lit(blocks))
        for k in range(blocks):
            own = wanted.filter(block == k) if blocks > 1 else wanted
            misses = own.join(self.rows().select("request_key"), "request_key", "left_anti")
            # Dealt by folder before anything is asked: few files, and no shuffle whose loss would ask again.
            misses = misses.withColumn("_prefix", prefix_of(F.col("request_key"))).repartition("_prefix")
            fresh = infer(misses, provider, **(settings or {}), **kwargs)
            self.add(fresh)
        return keyed.join(self.of(wanted), "request_key", "left")


def infer_cached(prompts: DataFrame, provider: Provider, cache: DataFrame, model_id: str, settings: dict | None = None, fresh_path: str | None = None, **kwargs) -> tuple[DataFrame, DataFrame]:
    """``prompts`` with ``outputs``, and the new rows for ``cache (request_key, outputs)``.

    Each distinct miss is asked once and its answer written (to ``fresh_path`` or the
    shared folder) before either result reads it.  A cache that repeats a key doubles no
    row: one of its answers counts.
    """
    keyed = prompts.withColumn("request_key", request_key(F.col("prompt"), model_id, settings))
    wanted = keyed.groupBy("request_key").agg(F.min("prompt").alias("prompt"))
    known = cache.groupBy("request_key").agg(F.min("outputs").alias("outputs"))
    misses = wanted.join(cache.select("request_key"), "request_key", "left_anti")
    asked = infer(misses, provider, **(settings or {}), **kwargs).select("request_key", "outputs")
    fresh = storage.materialized(asked, fresh_path or storage.fresh_path(prompts.sparkSession, "answers"))
    return keyed.join(known.unionByName(fresh), "request_key", "left"), fresh
