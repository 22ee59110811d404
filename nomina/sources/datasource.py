"""A database table as a source of batches and of streams, in key ranges."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType


@dataclass
class Range(InputPartition):
    """Keys above ``low`` up to ``high``."""

    low: int
    high: int


def _ranges(low: int, high: int, n: int) -> list[Range]:
    """The whole numbers above ``low`` up to ``high`` in at most ``n`` even
    ranges, none of them empty."""
    n = max(1, min(n, high - low))
    edges = [low + (high - low) * i // n for i in range(n + 1)]
    return [Range(a, b) for a, b in zip(edges, edges[1:]) if a < b]


class _Table:
    """What readers of one table need: its file, name, key and columns. Names are
    quoted, keys are passed as parameters."""

    def __init__(self, options: dict[str, str], schema: StructType):
        self.path, self.table, self.key = (options[k] for k in ("path", "table", "key"))
        self.parts, self.most = int(options.get("partitions", 4)), int(options.get("rowsperbatch", 100_000))
        self.columns = [f.name for f in schema.fields]

    @staticmethod
    def quoted(name: str) -> str:
        return '"' + name.replace('"', '""') + '"'

    def ask(self, sql: str, *values: int) -> Iterator[tuple]:
        con = sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)
        try:
            yield from con.execute(sql, values)
        finally:
            con.close()

    def ends(self) -> tuple[int, int] | None:
        key, table = self.quoted(self.key), self.quoted(self.table)
        low, high = next(self.ask(f"SELECT min({key}), max({key}) FROM {table}"))
        return None if low is None else (low - 1, high)

    def rows(self, low: int, high: int) -> Iterator[tuple]:
        key, columns = self.quoted(self.key), ", ".join(map(self.quoted, self.columns))
        yield from self.ask(f"SELECT {columns} FROM {self.quoted(self.table)} WHERE {key} > ? AND {key} <= ? ORDER BY {key}", low, high)

    def after(self, low: int, n: int) -> int | None:
        """The key of the ``n``-th row above ``low``, or of the last one."""
        key = self.quoted(self.key)
        return next(self.ask(f"SELECT max({key}) FROM (SELECT {key} FROM {self.quoted(self.table)} WHERE {key} > ? ORDER BY {key} LIMIT ?)", low, n))[0]


class RangeReader(DataSourceReader):
    """The table in ranges of its key, a task for each; a lost task reads its
    range again."""

    def __init__(self, table: _Table):
        self.table = table

    def partitions(self) -> list[Range]:
        ends = self.table.ends()
        return _ranges(*ends, self.table.parts) if ends else [Range(0, 0)]

    def read(self, partition: Range) -> Iterator[tuple]:
        yield from self.table.rows(partition.low, partition.high)


class QueueReader(DataSourceStreamReader):
    """The table as a queue in the order of its key: offsets are keys, and a batch
    has at most ``rowsPerBatch`` rows, dealt over ranges of keys. Rows are taken to
    be added with larger keys and not to change."""

    def __init__(self, table: _Table):
        self.table = table
        self.at: int | None = None

    def initialOffset(self) -> dict:  # noqa: N802 - Spark's names
        ends = self.table.ends()
        return {"key": ends[0] if ends else -(1 << 62)}

    def latestOffset(self) -> dict:  # noqa: N802
        if self.at is None:
            self.at = self.initialOffset()["key"]
        after = self.table.after(self.at, self.table.most)
        self.at = self.at if after is None else after
        return {"key": self.at}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        # After a stop the query goes on from where it was, not from the start.
        self.at = max(end["key"], self.at if self.at is not None else end["key"])
        return _ranges(start["key"], end["key"], self.table.parts) if start["key"] < end["key"] else []

    def read(self, partition: Range) -> Iterator[tuple]:
        yield from self.table.rows(partition.low, partition.high)

    def commit(self, end: dict) -> None:
        pass


class KeyedTable(DataSource):
    """Format ``keyed_table``. Options: ``path`` of a SQLite file that driver and
    executors can read, ``table``, ``key`` (a column of whole numbers), and if
    need be ``partitions`` (4) and ``rowsPerBatch`` (100,000). The schema is given
    by the reader; columns are read by name."""

    @classmethod
    def name(cls) -> str:
        return "keyed_table"

    def _table(self, schema: StructType) -> _Table:
        missing = [k for k in ("path", "table", "key") if k not in self.options]
        if missing:
            raise ValueError(f"keyed_table needs {', '.join(missing)}")
        return _Table({k: self.options[k] for k in ("path", "table", "key", "partitions", "rowsperbatch") if k in self.options}, schema)

    def reader(self, schema: StructType) -> RangeReader:
        return RangeReader(self._table(schema))

    def streamReader(self, schema: StructType) -> QueueReader:  # noqa: N802
        return QueueReader(self._table(schema))


def keyed_table(spark: SparkSession, path: str, table: str, key: str, schema: str, partitions: int = 4) -> DataFrame:
    """A table by ranges of its key."""
    spark.dataSource.register(KeyedTable)
    return spark.read.format("keyed_table").schema(schema).options(path=path, table=table, key=key, partitions=partitions).load()


def keyed_stream(spark: SparkSession, path: str, table: str, key: str, schema: str, rows: int = 100_000, partitions: int = 4) -> DataFrame:
    """A table as a stream of at most ``rows`` rows a batch."""
    spark.dataSource.register(KeyedTable)
    return spark.readStream.format("keyed_table").schema(schema).options(path=path, table=table, key=key, partitions=partitions, rowsPerBatch=rows).load()
