"""Extraction over streams of documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import extraction
from ..plans.extract import Spec, resolved


def rows(docs: DataFrame, spec: Spec) -> DataFrame:
    """Grounded extractions of a stream of documents, one row each.

    Documents are whole rows and chunks stay in theirs, so there is no state, and the chunk
    before is known; for chunks that come as rows of their own see ``context.previous``.
    """
    return extraction.extraction_rows(resolved(docs, spec))


def first_seen(docs: DataFrame, event_time: str, delay: str) -> DataFrame:
    """Documents whose id didn't come before within the watermark."""
    return docs.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["document_id"])


def class_counts(found: DataFrame, event_time: str, delay: str, window: str) -> DataFrame:
    """Extractions by window of event time and class, late ones up to ``delay`` included."""
    return found.withWatermark(event_time, delay).groupBy(F.window(event_time, window).alias("window"), "extraction_class").agg(F.count("*").alias("n"))


def annotate(docs: DataFrame, annotate_batch: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Annotates each micro-batch with the batch plan and writes it under its number; a batch that is run again replaces its own output."""

    def write(batch: DataFrame, number: int) -> None:
        annotate_batch(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
