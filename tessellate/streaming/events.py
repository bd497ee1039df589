"""Sessions of events, and extractions joined with what happened to their documents, over streams or tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def watermarked(rows: DataFrame, event_time: str, delay: str | None) -> DataFrame:
    return rows.withWatermark(event_time, delay) if delay else rows


def sessions(events: DataFrame, keys: list[str], event_time: str, gap: str, delay: str | None = None, *measures: Column) -> DataFrame:
    """``keys, session, n`` and ``measures`` of each session: a key's events without a pause of ``gap`` or more.

    In a stream, a session is final when the watermark (``delay`` behind the latest event)
    has passed its end; events that are later than that are dropped, all others count
    wherever they belong, also where they join two sessions.  Partial sessions are merged
    before they are shuffled.
    """
    window = F.session_window(event_time, gap).alias("session")
    return watermarked(events, event_time, delay).groupBy(*keys, window).agg(F.count("*").alias("n"), *measures)


def with_events(found: DataFrame, events: DataFrame, found_time: str, event_time: str, before: str = "0 seconds", after: str = "1 hour", delays: tuple[str, str] | None = None, key: str = "document_id", how: str = "inner") -> DataFrame:
    """Extractions with the events of their document from ``before`` ahead of them to ``after`` behind them.

    Both sides may be streams with a watermark each (``delays``); the bounds on time let
    each side forget rows that no later row of the other can meet.  With ``how`` left,
    extractions without events come out when that is certain.
    """
    left, right = (watermarked(r, t, d) for r, t, d in zip((found, events), (found_time, event_time), delays or (None, None), strict=True))
    right = right.withColumnRenamed(key, "_event_key")
    at, when = F.col(found_time), F.col(event_time)
    on = (F.col(key) == F.col("_event_key")) & (when >= at - F.expr(f"INTERVAL {before}")) & (when <= at + F.expr(f"INTERVAL {after}"))
    return left.join(right, on, how).drop("_event_key")
