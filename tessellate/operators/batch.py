"""Inference by batch jobs of a service, over a whole corpus.

Two phases, kept apart by tables in shared storage.  First all requests are made distinct,
get stable keys, are cut into jobs and written as one file of lines for each job.  Then the
driver, which sees jobs but never requests, hands the files to the service, waits, and lets
Spark read the answers' files into the table of answers.  No task ever waits for a service.

A run can be broken off at any time and started again with the same folder: requests that
have been written aren't written again, a job that the service has already got isn't sent
again, and answers that have been read are not read again.
"""

from __future__ import annotations

import json
import logging
import time
import uuid
from abc import ABC, abstractmethod
from collections import deque
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import suppress
from dataclasses import dataclass

import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import storage
from ..types import ProviderError
from .inference import OUTPUTS, Http, Provider, infer, request_key

log = logging.getLogger(__name__)
ANSWER = "request_key string, output string, error string"


@dataclass(frozen=True)
class BatchSettings:
    """When requests go by jobs, how they are cut, and how long is waited.

    Below ``threshold`` requests are asked one by one.  A failed request fails the run
    unless ``ignore_errors``; a missing answer is empty unless ``strict``, where it fails
    the run as well.
    """

    threshold: int = 50
    most_prompts: int = 20_000
    most_open: int = 100
    poll_seconds: float = 30.0
    timeout_seconds: float = 3600.0
    strict: bool = False
    ignore_errors: bool = False

    def __post_init__(self):
        if min(self.threshold, self.most_prompts, self.most_open) < 1 or self.poll_seconds <= 0 or self.timeout_seconds <= 0:
            raise ValueError("batch settings are positive")
        if self.strict and self.ignore_errors:
            raise ValueError("strict runs don't ignore errors")


# -- lines of a job's files ------------------------------------------------------------


class Lines(ABC):
    """How a service writes requests and answers, a line each."""

    @abstractmethod
    def request(self, key: str, prompt: str) -> dict: ...

    @abstractmethod
    def answer(self, row: dict) -> tuple[str | None, str | None, str | None]:
        """Key, output and error of an answer's line."""


class PlainLines(Lines):
    """``{"key", "prompt"}`` and ``{"key", "output"}`` or ``{"key", "error"}``."""

    def request(self, key, prompt):
        return {"key": key, "prompt": prompt}

    def answer(self, row):
        return row.get("key"), row.get("output"), row.get("error")


class KeyedLines(Lines):
    """``{"key", "request"}`` and ``{"key", "response"}``, with bodies as ``provider`` writes and reads them."""

    def __init__(self, provider: Http):
        self.provider = provider

    def request(self, key, prompt):
        return {"key": key, "request": self.provider.request(prompt, self.provider.settings)}

    def answer(self, row):
        key = row.get("key")
        if row.get("error") or not row.get("response"):
            return key, None, json.dumps(row.get("error") or row.get("status") or "no response", ensure_ascii=False)
        return key, *_read(self.provider, row["response"])


class CallLines(Lines):
    """Calls with ``custom_id``, method, address and body; answers have a status and a body."""

    def __init__(self, provider: Http, endpoint: str = "/v1/chat/completions"):
        self.provider, self.endpoint = provider, endpoint

    def request(self, key, prompt):
        return {"custom_id": key, "method": "POST", "url": self.endpoint, "body": self.provider.request(prompt, self.provider.settings)}

    def answer(self, row):
        key, response = row.get("custom_id"), row.get("response") or {}
        if row.get("error") or response.get("status_code") != 200:
            return key, None, json.dumps(row.get("error") or response or "no response", ensure_ascii=False)
        return key, *_read(self.provider, response.get("body"))


def _read(provider: Http, body) -> tuple[str | None, str | None]:
    try:
        return provider.read(body), None
    except (KeyError, IndexError, TypeError, ProviderError) as e:
        return None, f"no text in the answer: {e}"


# -- services --------------------------------------------------------------------------

RUNNING, OVER, FAILED = "running", "over", "failed"


class BatchService(ABC):
    """A service of batch jobs, as the driver sees it; files pass it by their paths only."""

    #: How many jobs may be sent at the same time.
    at_once = 1

    def find(self, job: str) -> str | None:
        """The service's own name of a job that it has got under this name, if it can tell."""
        return None

    @abstractmethod
    def send(self, job: str, path: str) -> str:
        """Starts a job with the files of lines below ``path``; returns the service's own name of it."""

    @abstractmethod
    def state(self, remote: str) -> str:
        """``running``, ``over`` or ``failed``."""

    @abstractmethod
    def answers(self, remote: str) -> list[str]:
        """Paths of the files with answers and errors of a job that is over."""

    def cancel(self, remote: str) -> None:
        """Called for jobs that took too long."""


class OfflineService(BatchService):
    """Does jobs at once with a provider, as Spark jobs; files are of :class:`PlainLines`."""

    at_once = 16

    def __init__(self, spark: SparkSession, folder: str, provider: Provider):
        self.spark, self.folder, self.provider = spark, folder, provider

    def find(self, job):
        return job if storage.exists(self.spark, f"{self.folder}/{job}/_SUCCESS") else None

    def send(self, job, path):
        rows = self.spark.read.schema("key string, prompt string").json(path)
        answered = infer(rows, self.provider).select("key", F.get("outputs", F.lit(0))["output"].alias("output"))
        answered.write.mode("overwrite").json(f"{self.folder}/{job}")
        return job

    def state(self, remote):
        return OVER

    def answers(self, remote):
        return [f"{self.folder}/{remote}"]


# -- runs ------------------------------------------------------------------------------

#: Jobs whose answers are read at the same time.
COLLECTED = 16


def _together(spark: SparkSession, call: Callable, items: list, most: int) -> list:
    """``call`` of each item, ``most`` at a time; after one that fails no other is begun."""
    if most == 1 or len(items) < 2:
        return [call(x) for x in items]
    with ThreadPoolExecutor(most) as pool:
        calls = [pool.submit(inheritable_thread_target(spark)(call), x) for x in items]
        try:
            return [c.result() for c in calls]
        except BaseException:
            pool.shutdown(cancel_futures=True)
            raise


class BatchRun:
    """Requests, jobs and answers of a run below one folder of shared storage.

    ``requests/wave=n`` (``request_key, prompt, job``) and ``lines/wave=n/job=...`` hold what
    is asked, ``jobs/...`` the service's name of each job sent, ``answers/job=...`` what
    came back.  Prompts that come later make a wave of their own; those that are known
    aren't asked again.
    """

    def __init__(
        self, spark: SparkSession, folder: str, service: BatchService, lines: Lines, model_id: str, settings: dict | None = None, batch: BatchSettings = BatchSettings(),
        single: Provider | None = None, sleep: Callable[[float], None] = time.sleep, on_job: Callable[[str, str], None] = lambda job, remote: None,
    ):
        self.spark, self.folder, self.service, self.lines = spark, folder, service, lines
        self.model_id, self.settings, self.batch, self.single, self.sleep, self.on_job = model_id, settings, batch, single, sleep, on_job

    # -- requests ----------------------------------------------------------------------

    def keyed(self, prompts: DataFrame, prompt_col: str = "prompt") -> DataFrame:
        return prompts.withColumn("request_key", request_key(F.col(prompt_col), self.model_id, self.settings))

    def waves(self) -> list[int]:
        """Waves whose requests and lines are complete."""
        found = [int(n.removeprefix("wave=")) for n in storage.names(self.spark, f"{self.folder}/lines")]
        return [n for n in found if storage.exists(self.spark, f"{self.folder}/lines/wave={n}/_SUCCESS")]

    def requests(self) -> DataFrame:
        """``request_key, prompt, job`` of all complete waves."""
        schema = "request_key string, prompt string, job string"
        paths = [f"{self.folder}/requests/wave={n}" for n in self.waves()]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def prepare(self, prompts: DataFrame, prompt_col: str = "prompt") -> int:
        """Writes the requests of prompts that no wave has; returns how many there are.

        Keys are dealt into buckets by hash, and a bucket is cut into jobs of at most
        ``most_prompts`` in the order of the keys, so the cut depends on the keys only.
        """
        wave = max(self.waves(), default=-1) + 1
        at = f"{self.folder}/requests/wave={wave}"
        wanted = self.keyed(prompts, prompt_col).groupBy("request_key").agg(F.min(prompt_col).alias("prompt"))
        fresh = wanted.join(self.requests().select("request_key"), "request_key", "left_anti")
        fresh.write.mode("overwrite").parquet(at + "-uncut")
        fresh = self.spark.read.schema("request_key string, prompt string").parquet(at + "-uncut")
        n = fresh.count()
        if not n:
            return 0
        single = n < self.batch.threshold and self.single is not None
        buckets = 1 if single else -(-n // self.batch.most_prompts)
        bucket = F.pmod(F.xxhash64("request_key"), F.lit(buckets))
        number = F.row_number().over(Window.partitionBy("_bucket").orderBy("request_key"))
        cut = fresh.withColumn("_bucket", bucket).withColumn("_part", F.floor((number - 1) / self.batch.most_prompts))
        job = F.lit("single") if single else F.concat_ws("-", F.lit(f"{wave:04d}"), F.lpad(F.col("_bucket").cast("string"), 6, "0"), F.lpad(F.col("_part").cast("string"), 4, "0"))
        cut.select("request_key", "prompt", job.alias("job")).write.mode("overwrite").parquet(at)
        rows = self.spark.read.schema("request_key string, prompt string, job string").parquet(at)
        if single:
            outputs = infer(rows, self.single, **(self.settings or {}))
            answers = outputs.select("request_key", F.get("outputs", F.lit(0))["output"].alias("output"), F.lit(None).cast("string").alias("error"))
            answers.write.mode("overwrite").parquet(f"{self.folder}/answers/job=single-{wave:04d}")
            rows = rows.limit(0)
        lines = self.lines

        def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                pairs = zip(batch.column("request_key").to_pylist(), batch.column("prompt").to_pylist(), strict=True)
                text = [json.dumps(lines.request(k, p), ensure_ascii=False) for k, p in pairs]
                yield pa.RecordBatch.from_arrays([batch.column("job"), pa.array(text, pa.string())], ["job", "value"])

        # A job's lines are one file: at most most_prompts of them pass one task.
        rows.repartition("job").mapInArrow(made, "job string, value string").write.partitionBy("job").mode("overwrite").text(f"{self.folder}/lines/wave={wave}")
        return n

    # -- jobs --------------------------------------------------------------------------

    def _id(self) -> str:
        """A name of this run that stays the same when it is started again."""
        path = f"{self.folder}/run"
        found = storage.get_text(self.spark, path)
        if found is None:
            storage.put_text(self.spark, path, found := uuid.uuid4().hex[:12])
        return found

    def jobs(self) -> dict[str, str]:
        """Every job and the path of its lines, by name; a name and a path for each, nothing of their requests."""
        return {n.removeprefix("job="): f"{self.folder}/lines/wave={w}/{n}" for w in self.waves() for n in storage.names(self.spark, f"{self.folder}/lines/wave={w}")}

    def _sent(self, run: str, job: str, path: str) -> str:
        record = f"{self.folder}/jobs/{job}"
        remote = storage.get_text(self.spark, record)
        if remote is None:
            name = f"{run}-{job}"
            remote = self.service.find(name)
            if remote is None:
                remote = self.service.send(name, path)
                self.on_job(job, remote)
            storage.put_text(self.spark, record, remote)
        return remote

    def _collect(self, job: str, paths: Sequence[str]) -> None:
        """Reads a job's answers into the table."""
        lines = self.lines

        def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = []
                for value in batch.column("value").to_pylist():
                    if value.strip():
                        try:
                            rows.append(lines.answer(json.loads(value)))
                        except (ValueError, AttributeError) as e:
                            rows.append((None, None, f"{value[:200]}: {e}"))
                rows = [r for r in rows if r[0] is not None or r[2] is not None]
                columns = zip(*rows, strict=True) if rows else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], ["request_key", "output", "error"])

        found = self.spark.read.text(list(paths)).mapInArrow(parsed, ANSWER)
        found.write.mode("overwrite").parquet(f"{self.folder}/answers/job={job}")

    def drive(self) -> None:
        """Sends all jobs, at most ``most_open`` at a time, and collects their answers; a job that fails or takes too long fails the run."""
        answered = {n.removeprefix("job=") for n in storage.names(self.spark, f"{self.folder}/answers")}
        answered = {j for j in answered if storage.exists(self.spark, f"{self.folder}/answers/job={j}/_SUCCESS")}
        waiting = deque((j, p) for j, p in sorted(self.jobs().items()) if j not in answered)
        run, open_ = self._id(), {}
        while waiting or open_:
            fresh = [waiting.popleft() for _ in range(min(len(waiting), self.batch.most_open - len(open_)))]
            remotes = _together(self.spark, lambda x: self._sent(run, *x), fresh, self.service.at_once)
            open_ |= {job: [remote, 0.0] for (job, _), remote in zip(fresh, remotes, strict=True)}
            over = {}
            for job, (remote, waited) in open_.items():
                state = self.service.state(remote)
                if state == OVER:
                    over[job] = self.service.answers(remote)
                elif state != RUNNING:
                    raise ProviderError(f"batch job {remote} ended as {state}")
                elif waited >= self.batch.timeout_seconds:
                    with suppress(Exception):
                        self.service.cancel(remote)
                    raise ProviderError(f"batch job {remote} took longer than {self.batch.timeout_seconds:g} s")
            _together(self.spark, lambda x: self._collect(*x), list(over.items()), COLLECTED)
            for job in over:
                del open_[job]
            if open_ and not over:
                self.sleep(self.batch.poll_seconds)
                for job in open_.values():
                    job[1] += self.batch.poll_seconds

    # -- answers -----------------------------------------------------------------------

    def answers(self) -> DataFrame:
        """``request_key, output, error``: one row a key; of several answers to a request one without an error counts."""
        if not storage.names(self.spark, f"{self.folder}/answers"):
            return self.spark.createDataFrame([], ANSWER)
        rows = self.spark.read.schema(ANSWER + ", job string").parquet(f"{self.folder}/answers")
        best = F.min(F.struct(F.col("error").isNotNull().alias("failed"), "job", "output", "error"))
        return rows.groupBy("request_key").agg(best.alias("x")).select("request_key", "x.output", "x.error")

    def check(self) -> None:
        """Raises for failed answers, and in strict runs for requests without one."""
        if not self.batch.ignore_errors:
            failed = self.answers().filter("error IS NOT NULL").limit(3).collect()
            if failed:
                raise ProviderError("batch requests failed: " + "; ".join(f"{r.request_key}: {r.error}" for r in failed))
        if self.batch.strict:
            missing = self.requests().join(self.answers(), "request_key", "left_anti").limit(3).collect()
            if missing:
                raise ProviderError("batch requests without an answer: " + ", ".join(r.request_key for r in missing))

    def outputs(self, prompts: DataFrame, prompt_col: str = "prompt") -> DataFrame:
        """``prompts`` with ``request_key`` and ``outputs``, from the answers; a missing one is empty."""
        one = F.array(F.struct(F.lit(1.0).alias("score"), F.coalesce("output", F.lit("")).alias("output"))).cast(OUTPUTS)
        return self.keyed(prompts, prompt_col).join(self.answers().select("request_key", "output"), "request_key", "left").withColumn("outputs", one).drop("output")

    def infer(self, prompts: DataFrame, prompt_col: str = "prompt") -> DataFrame:
        """All of it: requests, jobs, answers; ``prompts`` with ``request_key`` and ``outputs``."""
        self.prepare(prompts, prompt_col)
        self.drive()
        self.check()
        return self.outputs(prompts, prompt_col)
