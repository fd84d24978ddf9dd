"""Request flow: retries, admission, and ingestion of streams."""

from __future__ import annotations

import random
import threading
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

RETRYABLE = ("ServiceUnavailable", "Timeout", "RateLimited")


def backoff_ms(attempt: Column, base: int = 1000, cap: int = 30_000) -> Column:
    """The wait before a retry without jitter: doubling up to a cap."""
    return F.least(F.lit(base) * F.pow(F.lit(2.0), attempt).cast("long"), F.lit(cap).cast("long"))


def admission(requests: DataFrame, queue: str, order: str, arrival: str, gap: int) -> DataFrame:
    """Adds start_ms: first come, first served, with at least `gap` between starts of a queue.

    A request starts at the latest of all earlier arrivals, each put off by the gaps after it, so no row waits for another's result.
    """
    w = Window.partitionBy(queue).orderBy(arrival, order)
    rows = requests.withColumn("_i", F.row_number().over(w))
    latest = F.max(F.col(arrival) - F.col("_i") * gap).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("start_ms", latest + F.col("_i") * gap).drop("_i")


@dataclass
class Retry:
    """A call made again while it fails in a way that may pass, within a total deadline; `stop` ends waits at once."""

    attempts: int = 6
    base_s: float = 1.0
    cap_s: float = 30.0
    jitter: float = 0.25
    deadline_s: float = 60.0

    def call(self, f: Callable[[], object], retryable: Callable[[Exception], bool], stop: threading.Event | None = None) -> object:
        stop, end = stop or threading.Event(), time.monotonic() + self.deadline_s
        for n in range(self.attempts + 1):
            try:
                return f()
            except Exception as e:
                wait = min(self.base_s * 2**n, self.cap_s) * random.uniform(1 - self.jitter, 1 + self.jitter)
                if n == self.attempts or not retryable(e):
                    raise
                if time.monotonic() + wait > end:
                    raise TimeoutError(f"no success within {self.deadline_s} s") from e
                if stop.wait(wait):
                    raise InterruptedError("cancelled while waiting to try again") from e
        raise AssertionError


class Admission:
    """Starts of calls at least a gap apart, so many at once and so many waiting at most; in order of arrival."""

    def __init__(self, gap_s: float, in_flight: int, waiting: int | None = None) -> None:
        self.gap_s, self.waiting = gap_s, waiting
        self._slots, self._turn, self._lock = threading.Semaphore(in_flight), threading.Lock(), threading.Lock()
        self._last, self._queued = 0.0, 0

    def __enter__(self) -> Admission:
        with self._lock:
            if self.waiting is not None and self._queued >= self.waiting:
                raise RuntimeError("queue_full")
            self._queued += 1
        with self._turn:
            self._slots.acquire()
            time.sleep(max(0.0, self._last + self.gap_s - time.monotonic()))
            self._last = time.monotonic()
        with self._lock:
            self._queued -= 1
        return self

    def __exit__(self, *exc: object) -> None:
        self._slots.release()


def with_deadline(spark: SparkSession, seconds: float, f: Callable[[], object], group: str) -> object:
    """An action that is cancelled with all its jobs when its time is up."""
    spark.sparkContext.setJobGroup(group, f"at most {seconds} s", interruptOnCancel=True)
    timer = threading.Timer(seconds, lambda: spark.sparkContext.cancelJobGroup(group))
    timer.start()
    try:
        return f()
    finally:
        timer.cancel()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def file_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 8) -> DataFrame:
    """Parquet files as a stream; path may be a folder or a pattern."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def counts_by_type(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Events by type; the time column is an instant, and later rows than `late` may be dropped in append mode."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(30,6)")).alias("total"))


def windowed_counts(events: DataFrame, width: str, late: str) -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"))


def with_missing(requests: DataFrame, replies: DataFrame, key: str) -> DataFrame:
    """Every request with its reply; those a service dropped come back as not_found."""
    return requests.join(replies, key, "left").withColumn("status", F.coalesce("status", F.lit("not_found")))
