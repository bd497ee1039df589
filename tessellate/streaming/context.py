"""The context of the chunk before, for chunks that arrive one by one and out of order."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StringType, StructField, StructType

#: The state store that stateful processors need.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _Previous(StatefulProcessor):
    """A document's state: ends of chunks whose successor hasn't come, and chunks whose predecessor hasn't."""

    def __init__(self, columns: list[str], schema: StructType, event_time: str, chars: int, hold_ms: int):
        self.columns, self.schema, self.event_time, self.chars, self.hold_ms = columns, schema, event_time, chars, hold_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ends = handle.getMapState("ends", "chunk_index int", "text string")
        self.waiting = handle.getMapState("waiting", "chunk_index int", self.schema)

    def _row(self, values: tuple, previous: str | None) -> Row:
        return Row(*self.columns, "previous")(*values, previous)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        latest = 0
        for row in rows:
            values = tuple(row[c] for c in self.columns)
            k, text = row["chunk_index"], (row["chunk_text"] or "")[-self.chars :]
            latest = max(latest, int(row[self.event_time].timestamp() * 1000))
            if k == 0:
                yield self._row(values, None)
            elif self.ends.containsKey((k - 1,)):
                yield self._row(values, self.ends.getValue((k - 1,))[0])
                self.ends.removeKey((k - 1,))
            else:
                self.waiting.updateValue((k,), values)
            if self.waiting.containsKey((k + 1,)):
                yield self._row(tuple(self.waiting.getValue((k + 1,))), text)
                self.waiting.removeKey((k + 1,))
            else:
                self.ends.updateValue((k,), (text,))
        for timer in self.handle.listTimers():
            latest = max(latest, timer - self.hold_ms)
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(latest + self.hold_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        """Nothing more comes: chunks that still wait go without the end of the one before, and the state with them."""
        if self.waiting.exists():
            for _, values in sorted(self.waiting.iterator(), key=lambda x: x[0][0]):
                yield self._row(tuple(values), None)
        self.waiting.clear()
        self.ends.clear()

    def close(self) -> None:
        pass


def previous(chunks: DataFrame, event_time: str, delay: str, chars: int, hold_ms: int = 600_000, id_col: str = "document_id") -> DataFrame:
    """``chunks`` with ``previous``: the last ``chars`` characters of the document's chunk before, whatever order they come in.

    A chunk goes on as soon as the one before it has been seen; the first (number 0) at
    once.  Numbers are without gaps and each comes once.  When the watermark (``delay``
    behind the latest ``event_time``) has passed a document's latest chunk by ``hold_ms``,
    its state is dropped, and chunks still waiting go on without context.  A document's
    state is the chunks around its gaps only.  ``operators.documents.in_context`` makes
    the prompts' context of it.
    """
    spark = chunks.sparkSession
    if spark.conf.get(*STORE[:1], "") != STORE[1]:
        raise ValueError(f"{STORE[0]} must be {STORE[1]}")
    schema = StructType([StructField(f.name, f.dataType) for f in chunks.schema.fields])
    out = StructType([*schema.fields, StructField("previous", StringType())])
    grouped = chunks.withWatermark(event_time, delay).groupBy(id_col)
    return grouped.transformWithState(_Previous(chunks.columns, schema, event_time, chars, hold_ms), out, "Append", "EventTime")
