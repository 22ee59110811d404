"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word of a text, for Spark's and DuckDB's regular expressions alike.
WORD = r"[^\x20\x09-\x0D]+"


def checkpoint(df: DataFrame, compact: bool = False) -> DataFrame:
    """Cut lineage with files in the folder the cluster names in
    ``spark.checkpoint.dir``. Only a local master may go without: its driver and
    tasks share one machine's folders. Elsewhere an unset folder is an error.
    ``compact``: for few columns made of many large partitions, rows are first
    dealt into partitions of the advisory size, so that files are few."""
    df = df.hint("rebalance") if compact else df
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None:
            if not spark.sparkContext.master.split("[")[0] == "local":
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            shared = tempfile.mkdtemp(prefix="checkpoint-")
            atexit.register(shutil.rmtree, shared, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(shared)
    return df.checkpoint()


#: Rows of a few numbers that make a partition.
FEW = 100_000


def gathered(df: DataFrame, few: int = FEW) -> DataFrame:
    """``checkpoint``, then a partition for every ``few`` rows that were written,
    if there are more partitions. What is small takes a task or some then, rather
    than as many as there are shuffle partitions, and joins and groups of tables of
    one partition shuffle nothing."""
    df = checkpoint(df)
    n = df.count()
    return single(df, n) if n <= few else df.coalesce(-(-n // few))


def single(df: DataFrame, rows: int) -> DataFrame:
    """All of a table of ``rows`` rows as one partition. The limit drops nothing: it
    tells the planner how many there are, which would else multiply its guesses
    from join to join until these numbers fill the driver."""
    return df.coalesce(1).limit(max(1, rows))


def is_single(written: DataFrame) -> bool:
    """Whether a table that has been written out is read as one partition."""
    return written.rdd.getNumPartitions() == 1


def unused(name: str, columns: list[str]) -> str:
    """A column name that ``columns`` lack, whatever their case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def raw(text: str) -> Column:
    """A text column as UTF-8 bytes. ``bytes.split()`` then cuts at exactly the
    six ASCII spaces, and ``bytes.lower()`` touches A-Z alone."""
    return F.col(text).cast("binary")


def map_rows(
    df: DataFrame,
    fn: Callable[[list[list]], list[list]],
    schema: str,
    step: int = 512,
    size: int = 4_000_000,
) -> DataFrame:
    """Apply ``fn`` (columns as lists to columns as lists or arrays) to runs of
    at most ``step`` rows, fewer if the second column holds long texts: a run
    ends once its texts pass ``size`` bytes. Memory stays bounded by that and
    by the longest single text."""
    from pyspark.sql.types import _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            weights = batch.column(1) if batch.num_columns > 1 else None
            for at, n in cuts(batch.num_rows, weights, step, size):
                part = batch.slice(at, n)
                made = fn([c.to_pylist() for c in part.columns])
                arrays = [x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(made, arrow, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return df.mapInArrow(run, schema)


def cuts(rows: int, texts: pa.Array | None, step: int = 512, size: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Start and length of runs of at most ``step`` rows; a run ends once its
    texts pass ``size`` bytes."""
    if texts is None or not (pa.types.is_binary(texts.type) or pa.types.is_string(texts.type)):
        yield from ((at, min(step, rows - at)) for at in range(0, rows, step))
        return
    import pyarrow.compute as pc

    at, held = 0, 0
    for i, n in enumerate(pc.binary_length(texts).to_pylist()):
        held += n or 0
        if i + 1 - at >= step or held >= size or i + 1 == rows:
            yield at, i + 1 - at
            at, held = i + 1, 0


def bounded_sample(df: DataFrame, key: str, bound: int, seed: int = 42) -> DataFrame:
    """The same at most ``bound`` rows on every run: those with the smallest
    hashes of ``key``. A rate drawn from the count first thins the rows, so no
    task sends many more than its share to the final top-k."""
    total = df.count()
    order = F.xxhash64(F.lit(seed), F.col(key))
    if total > bound:
        limit = int(min(1.0, 1.3 * bound / total) * (1 << 32))
        df = df.filter(F.pmod(order, F.lit(1 << 32)) < limit)
    return df.orderBy(order, F.col(key)).limit(bound)


def remainder(column: str, modulus: int) -> Column:
    """crc32 of an id's text, modulo ``modulus``; null for a null id."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(modulus))


def partitions(df: DataFrame) -> int:
    """The session's number of shuffle partitions."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
