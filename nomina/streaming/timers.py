"""Retries that time out: a record's tries as state, with timers for the wait."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.loading import error_type

#: The state store that state with timers needs.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "record_id string, at timestamp, tries int, error_type string, action string"


@contextmanager
def with_timers(spark: SparkSession) -> Iterator[None]:
    """Choose the state store for queries started inside."""
    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting, None)
    spark.conf.set(setting, PROVIDER)
    try:
        yield
    finally:
        spark.conf.unset(setting) if before is None else spark.conf.set(setting, before)


class Retries(StatefulProcessor):
    """Tries of one record in order of time. A failure that may be retried waits
    for the next try until ``wait`` has passed; then the record is stuck. After
    ``most`` such failures in a row it is dead. Either way, and after a success or
    another failure, it starts anew."""

    def __init__(self, most: int, wait_ms: int):
        self.most, self.wait = most, wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "tries int, due long")

    def _row(self, key: tuple, ms: int, tries: int, kind: str | None, action: str) -> tuple:
        return key[0], pd.Timestamp(ms, unit="ms"), tries, kind, action

    def _frame(self, rows: list[tuple]) -> Iterator[pd.DataFrame]:
        if rows:
            yield pd.DataFrame(rows, columns=["record_id", "at", "tries", "error_type", "action"])

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803 - Spark's names
        parts = list(rows)  # a record's tries within one batch
        tries = pd.concat(parts).sort_values(["at_ms", "n"], kind="stable")
        count, due = self.held.get() if self.held.exists() else (0, 0)
        if due:
            self.handle.deleteTimer(due)
        out = []
        for ms, kind in zip(tries["at_ms"].tolist(), tries["error_type"].tolist()):
            if due and ms > due:  # it has waited in vain before this try
                out.append(self._row(key, due, count, "retryable", "stuck"))
                count = 0
            kind, due = None if pd.isna(kind) else kind, 0
            count += 1
            if kind == "retryable" and count < self.most:
                out.append(self._row(key, ms, count, kind, "retry"))
                due = ms + self.wait
            else:
                out.append(self._row(key, ms, count, kind, "done" if kind is None else "dead"))
                count = 0
        if due:
            self.handle.registerTimer(due)
            self.held.update((count, due))
        else:
            self.held.clear()
        yield from self._frame(out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        count, due = self.held.get() if self.held.exists() else (0, 0)
        if due and due == expiredTimerInfo.getExpiryTimeInMs():
            self.held.clear()
            yield from self._frame([self._row(key, due, count, "retryable", "stuck")])

    def close(self) -> None:
        pass


def outcomes(stream: DataFrame, most: int = 3, wait_seconds: float = 600, late: str = "0 seconds") -> DataFrame:
    """What becomes of a stream of tries (``record_id, ts, n, message``, the
    message null on success, ``n`` their order at equal times): ``record_id, at,
    tries, error_type, action``, a row for each try (done, retry or dead) and one
    for each record that is stuck, at the time its wait ends. Tries may come
    ``late`` by so much; later ones are dropped. Needs ``with_timers``. State is
    a number and a time for each record that waits; rows without an id or a time
    are left out."""
    typed = stream.filter("record_id is not null and ts is not null").withWatermark("ts", late)
    typed = typed.select("record_id", "ts", F.unix_millis("ts").alias("at_ms"), "n", error_type(F.col("message")).alias("error_type"))
    return typed.groupBy("record_id").transformWithStateInPandas(Retries(most, int(1000 * wait_seconds)), OUT, "Append", "EventTime")
