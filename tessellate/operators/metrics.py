"""Figures of a run, taken while it runs."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener


def _figures(classes: list[str]) -> list[Column]:
    grounded = F.filter("extractions", lambda e: e["char_interval"].isNotNull())
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    of = lambda name: F.size(F.filter("extractions", lambda e: e["extraction_class"] == name))
    return [
        F.count(F.lit(1)).alias("documents"),
        total(F.length("text")).alias("characters"),
        total(F.size("extractions")).alias("extractions"),
        total(F.size(grounded)).alias("grounded"),
        *[total(of(name)).alias(f"class:{name}") for name in classes],
    ]


def observed(annotated: DataFrame, classes: list[str], name: str = "extraction") -> tuple[DataFrame, Observation | str]:
    """``annotated`` with its figures taken on the way, and where they are found when it has been written.

    Figures are those of ``extraction.summary``, and the number of extractions of each of
    the given ``classes`` (those of the prompt's examples), without a second pass.  A
    stream's go to its listeners under ``name`` (:class:`ProgressLog`).
    """
    if annotated.isStreaming:
        return annotated.observe(name, *_figures(classes)), name
    observation = Observation(name)
    return annotated.observe(observation, *_figures(classes)), observation


def run_summary(figures: dict, seconds: float | None = None) -> dict:
    """Figures of an observation as a run's summary: classes that occurred, extractions of none of those named, and rates."""
    named = {k.removeprefix("class:"): v for k, v in figures.items() if k.startswith("class:")}
    out = {k: v for k, v in figures.items() if not k.startswith("class:")}
    out |= {"by_class": {k: v for k, v in named.items() if v}, "other": out["extractions"] - sum(named.values())}
    out["classes"] = len(out["by_class"]) + (out["other"] > 0)
    return out | ({"characters_a_second": out["characters"] / seconds} if seconds else {})


class ProgressLog(StreamingQueryListener):
    """Tells ``say`` a stream's figures after each micro-batch, and their sums when it ends."""

    def __init__(self, say: Callable[[dict], None], name: str = "extraction"):
        self.say, self.name, self.sums, self.began = say, name, {}, time.time()

    def onQueryStarted(self, event) -> None:
        self.began = time.time()

    def onQueryProgress(self, event) -> None:
        figures = event.progress.observedMetrics.get(self.name)
        if figures is not None:
            row = figures.asDict()
            for k, v in row.items():
                self.sums[k] = self.sums.get(k, 0) + v
            self.say({"batch": event.progress.batchId, "rows_a_second": event.progress.processedRowsPerSecond} | run_summary(row))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if self.sums:
            self.say({"batch": None} | run_summary(self.sums, time.time() - self.began))
