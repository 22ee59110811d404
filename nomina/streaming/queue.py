"""Queue workloads on Structured Streaming: retries with dead letters, and
running tallies. The reference workloads have no event time; watermarks here
bound state and are an extension."""

from __future__ import annotations

import time
import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.loading import error_type

EVENT = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def source(spark: SparkSession, path: str, schema: str = EVENT, files: int = 10, only: str = "*.parquet") -> DataFrame:
    """A folder's Parquet files whose names match ``only`` as a stream, at most
    ``files`` at a time: the bound on work in flight."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("pathGlobFilter", only).parquet(path)


def drained(stream: DataFrame, mode: str = "append", timeout: int = 300) -> DataFrame:
    """What a stream gives once all that is there has been read, as a table in
    memory: for small results, as running totals are."""
    name = f"drained_{uuid.uuid4().hex}"
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination(timeout)
    if query.isActive:
        query.stop()
        raise TimeoutError(f"the stream took more than {timeout} s")
    return stream.sparkSession.table(name)


def written(stream: DataFrame, path: str, checkpoint: str, timeout: int = 300) -> DataFrame:
    """What a stream gives once all that is there has been read, as Parquet at
    ``path``: for results of any size, whose rows never pass the driver."""
    spark = stream.sparkSession
    query = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", path).trigger(availableNow=True).start()
    if not query.awaitTermination(timeout):
        query.stop()
        raise TimeoutError(f"the stream took more than {timeout} s")
    return spark.read.schema(stream.schema).parquet(path)


def deduplicated(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Each event once, within the watermark."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


def running_tally(stream: DataFrame, window: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Outcomes by window of event time."""
    outcome = F.when(F.col("event_type") == "error", "failed").otherwise("ok")
    return stream.withWatermark("ts", delay).groupBy(F.window("ts", window), outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean_value"))


def attempts(stream: DataFrame, most: int = 3) -> DataFrame:
    """A stream of tries (``record_id, message``, null on success) with each
    record's number of tries and what to do: done, retry or dead."""
    out = "record_id string, tries int, error_type string, action string"

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tries = state.get[0] if state.exists else 0
        rows = []
        for part in parts:
            for kind in part["error_type"]:
                tries += 1
                kind = None if pd.isna(kind) else kind
                action = "done" if kind is None else "retry" if kind == "retryable" and tries < most else "dead"
                rows.append((key[0], tries, kind, action))
        if rows and rows[-1][3] != "retry":
            state.remove()
        else:
            state.update((tries,))
        yield pd.DataFrame(rows, columns=["record_id", "tries", "error_type", "action"])

    typed = stream.select("record_id", error_type(F.col("message")).alias("error_type"))
    return typed.groupBy("record_id").applyInPandasWithState(step, out, "tries int", "append", GroupStateTimeout.NoTimeout)


def drain(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None):
    """Hand each batch of a queue to ``handle``. Without ``every`` what is there
    is drained and the query ends; with it, the queue is polled at that pace. A
    batch may come again after a failure: handlers overwrite by batch id."""
    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


@dataclass
class Totals:
    """What a queue has given so far, by outcome, and the query that drains it."""

    outcomes: Counter = field(default_factory=Counter)
    batches: int = 0
    seconds: float = 0.0
    query: StreamingQuery | None = None

    def rate(self) -> float:
        """Messages a second while batches ran."""
        return sum(self.outcomes.values()) / self.seconds if self.seconds else 0.0


def redo(
    stream: DataFrame, process: Callable[[DataFrame], DataFrame], checkpoint: str, every: str | None = None, report: float = 150.0, stuck: float = 600.0, say: Callable[[str], None] = print
) -> Totals:
    """Drain a queue through ``process``, which gives ``record_id, error_type``.

    The bound on work in flight is the source's files a batch; with ``every`` an
    empty queue is asked again at that pace. Retryable and bad messages are
    counted and dropped, while a failure of ``process`` itself ends the query.
    Totals are told every ``report`` seconds, with rate; a batch that took longer
    than ``stuck`` seconds is told at once. A batch that comes again after a
    failure counts again."""
    totals = Totals()
    told = time.monotonic()

    def handle(batch: DataFrame, number: int) -> None:
        nonlocal told
        began = time.monotonic()
        outcome = F.coalesce("error_type", F.lit("success"))
        for r in process(batch).groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n")).collect():
            totals.outcomes[r["outcome"]] += r["n"]
        took = time.monotonic() - began
        totals.batches, totals.seconds = totals.batches + 1, totals.seconds + took
        if took > stuck:
            say(f"batch {number} took {took:.0f} s: is the queue stuck?")
        if time.monotonic() - told > report:
            told = time.monotonic()
            say(f"{sum(totals.outcomes.values())} messages, {totals.rate():.1f} a second: {dict(totals.outcomes)}")

    totals.query = drain(stream, handle, checkpoint, every)
    return totals
