"""Progress of long jobs: a row for each batch of a stream, with rate and time left."""

from __future__ import annotations

import json
import threading
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

ROW = "run string, batch long, at timestamp, rows long, seconds double, done long, rate double, seconds_left double, observed map<string,long>"


class Progress(StreamingQueryListener):
    """Keeps what each batch with rows has done, by run, and appends it to a table
    at ``path`` every ``keep`` batches and as a query ends; the driver holds fewer
    than ``keep`` rows a run. ``expected``: rows of a whole run, for the time left,
    null without it. Numbers observed on the stream (``DataFrame.observe``) come
    with the batch.

        progress = Progress(spark, path, expected=1_000_000)
        spark.streams.addListener(progress)
    """

    def __init__(self, spark: SparkSession, path: str, expected: int | None = None, keep: int = 100):
        self.spark, self.path, self.expected, self.keep = spark, path, expected, keep
        self.rows: list[tuple] = []
        self.totals: dict[str, tuple[int, float]] = {}
        self.lock, self.over = threading.Lock(), threading.Event()

    def onQueryStarted(self, event) -> None:  # noqa: N802 - Spark's names
        self.over.clear()

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = json.loads(event.progress.json)
        if not p["numInputRows"]:
            return
        observed = {k: int(v) for of in (p.get("observedMetrics") or {}).values() for k, v in of.items() if isinstance(v, (int, float))}
        at = datetime.strptime(p["timestamp"], "%Y-%m-%dT%H:%M:%S.%fZ")
        with self.lock:
            done, spent = self.totals.get(p["runId"], (0, 0.0))
            done, spent = done + p["numInputRows"], spent + p["durationMs"].get("triggerExecution", 0) / 1000
            self.totals[p["runId"]] = done, spent
            rate = done / spent if spent else None
            left = (self.expected - done) / rate if rate and self.expected is not None else None
            self.rows.append((p["runId"], p["batchId"], at, p["numInputRows"], p["durationMs"].get("triggerExecution", 0) / 1000, done, rate, left, observed))
            full = len(self.rows) >= self.keep
        if full:
            self.flush()

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.flush()
        self.over.set()

    def flush(self) -> None:
        with self.lock:
            rows, self.rows = self.rows, []
        if rows:
            self.spark.createDataFrame(rows, ROW).coalesce(1).write.mode("append").parquet(self.path)


def observed(stream: DataFrame, outcome: str = "error_type") -> DataFrame:
    """``stream`` with its rows and failures counted by Spark as they pass."""
    return stream.observe("load", F.count(F.lit(1)).alias("attempts"), F.count(outcome).alias("failures"))


def followed(stream: DataFrame, path: str, table: str, checkpoint: str, expected: int | None = None, timeout: int = 300) -> DataFrame:
    """Append what is there of ``stream`` to the table at ``path``, keep its
    progress in another at ``table``, and return that."""
    spark = stream.sparkSession
    progress = Progress(spark, table, expected)
    spark.streams.addListener(progress)
    try:
        query = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", path).trigger(availableNow=True).start()
        if not query.awaitTermination(timeout):
            query.stop()
            raise TimeoutError(f"the stream took more than {timeout} s")
        progress.over.wait(60)
    finally:
        spark.streams.removeListener(progress)
    progress.flush()
    return spark.read.schema(ROW).parquet(table)
