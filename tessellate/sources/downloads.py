"""Texts of addresses, fetched by tasks that each keep to the pace of their hosts."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .documents import download, is_url

SCHEMA = "url string, text string, error string"


def fetched(urls: DataFrame, url_col: str = "url", per_second: float = 1.0, get: Callable[[str], str] = download, retries: int = 2, sleep: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.monotonic) -> DataFrame:
    """``url, text, error``: a row for each distinct address, fetched or not.

    All addresses of a host are one task's, which asks it ``per_second`` times a second at
    most; addresses of different hosts take turns in the order of the host's next free
    moment only as far as they come together, so give it as many partitions as hosts may be
    asked at once.  What isn't an address, or fails after ``retries`` further tries, is a
    row with an ``error`` instead of a text; nulls give no row.  Write the result before
    using it twice: whatever reads it would fetch again.
    """
    host = F.lower(F.coalesce(F.try_parse_url(F.trim("url"), F.lit("HOST")), F.lit("")))
    rows = urls.select(F.col(url_col).cast("string").alias("url")).filter("url IS NOT NULL").distinct().withColumn("host", host)

    def one(url: str) -> tuple[str | None, str | None]:
        for attempt in range(retries + 1):
            try:
                return get(url.strip()), None
            except Exception as e:
                if attempt == retries:
                    return None, f"{type(e).__name__}: {e}"
                sleep(2.0**attempt / per_second)
        raise AssertionError

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free: dict[str, float] = {}
        for batch in batches:
            for url in batch.column("url").to_pylist():
                text, error = None, "not an address"
                if is_url(url):
                    name = urlsplit(url.strip()).hostname or ""
                    if (wait := free.get(name, 0.0) - clock()) > 0:
                        sleep(wait)
                    text, error = one(url)
                    free[name] = clock() + 1.0 / per_second
                yield pa.RecordBatch.from_arrays([pa.array([url]), pa.array([text], pa.string()), pa.array([error], pa.string())], ["url", "text", "error"])

    return rows.repartition("host").sortWithinPartitions(F.xxhash64("url")).select("url").mapInArrow(run, SCHEMA)
