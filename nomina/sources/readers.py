"""Sources: text lines, JSON lines, CSV and report files, and tables."""

from __future__ import annotations

import itertools
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.records import RECORD

CODECS = (".bz2", ".gz", ".json", ".jsonl")


def lines(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """``file, ordinal, value``: the lines of text files, numbered from 1 in each,
    decompressed by suffix; ``strict`` refuses other suffixes. Files are read in
    splits: Spark's row numbers run through a split, and the counts of a file's
    splits, a small table, tell where each begins."""
    if strict and not path.rstrip("*/").endswith(CODECS) and "." in path.rsplit("/", 1)[-1]:
        raise ValueError(f"unknown kind of file: {path}")
    rows = spark.read.text(path, lineSep="\n").select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_id"), "value"
    )
    splits = rows.groupBy("file", "_start").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))
    before = F.sum("_n").over(Window.partitionBy("file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1))
    offsets = splits.select("file", "_start", "_first", F.coalesce(before, F.lit(0)).alias("_before"))
    numbered = rows.join(F.broadcast(offsets), ["file", "_start"])
    return numbered.select("file", (F.col("_before") + F.col("_id") - F.col("_first") + 1).cast("long").alias("ordinal"), "value")


def standard_input(spark: SparkSession, stream: Iterable[str], rows: int = 100_000) -> DataFrame:
    """``ordinal, value``: lines that a pipe brings to the driver, such as
    ``sys.stdin``, in partitions of ``rows``. A pipe can't be read again, so the
    driver holds all of its lines as long as the frame is used: for files, which
    have no such limit, see ``lines``."""
    schema = "ordinal long, value string"
    parts, numbers = [], itertools.count(1)
    lines_ = (x.rstrip("\n") for x in stream)
    while piece := list(itertools.islice(lines_, rows)):
        parts.append(spark.sparkContext.parallelize([(next(numbers), x) for x in piece], 1))
    return spark.createDataFrame(spark.sparkContext.union(parts), schema) if parts else spark.createDataFrame([], schema)


def scanned(spark: SparkSession, path: str) -> DataFrame:
    """``value``: lines without ordinals, the scalable scan of splittable files."""
    return spark.read.text(path)


def parse_line(line: Column, comma: bool = True) -> Column:
    """A trimmed line without one trailing comma; null if shorter than ten."""
    line = F.regexp_replace(line, r"^\s+|\s+$", "")
    return F.when(F.length(line) >= 10, F.regexp_replace(line, ",$", "") if comma else line)


def decoded(rows: DataFrame, line: str = "value", schema: str = RECORD, tolerant: bool = True) -> DataFrame:
    """Rows with ``raw`` and the JSON's fields. Lines that don't parse are
    dropped, or, unless ``tolerant``, fail the query; extra keys live on in
    ``raw``."""
    rows = rows.filter(F.col(line).isNotNull())
    if not tolerant:
        return rows.withColumn("_r", F.from_json(line, schema, {"mode": "FAILFAST"})).select("*", F.col(line).alias("raw"), "_r.*").drop("_r")
    parsed = rows.withColumn("_r", F.from_json(line, schema + ", _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    kept = parsed.filter("_r is not null and _r._corrupt is null")
    return kept.select(*rows.columns, F.col(line).alias("raw"), "_r.*").drop("_corrupt")


def records(spark: SparkSession, path: str, comma: bool = True) -> DataFrame:
    """Tolerant read of JSON lines records."""
    return decoded(scanned(spark, path).withColumn("value", parse_line(F.col("value"), comma))).drop("value")


def alias_csv(spark: SparkSession, path: str) -> DataFrame:
    """``id, canonical, name, language`` from CSV with a header, quotes doubled
    inside quoted fields, which may hold line breaks."""
    return spark.read.csv(path, schema="id string, canonical string, name string, language string", header=True, quote='"', escape='"', multiLine=True)


def reports(spark: SparkSession, paths: str | list[str], schema: str) -> DataFrame:
    """Whole-file JSON reports with ``source_file``; files that don't parse are
    left out."""
    rows = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_name").alias("source_file"), "value")
    return decoded(rows, "value", schema).drop("value", "raw")


def embedding_table(spark: SparkSession, path: str) -> DataFrame:
    """``feat_id, label, embedding``."""
    return spark.read.schema("feat_id bigint, label string, embedding array<float>").parquet(path)


def jdbc_table(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, parts: int, **options: str) -> DataFrame:
    """An embedding table in a database, read in ``parts`` ranges of its key;
    vectors come as text and become arrays."""
    rows = spark.read.jdbc(url, f"(SELECT {key}, label, CAST(embedding AS text) AS embedding FROM {table}) t", column=key, lowerBound=low, upperBound=high, numPartitions=parts, properties=options)
    return rows.select(F.col(key).alias("feat_id"), "label", F.from_json("embedding", "array<float>").alias("embedding"))


def first_lines(rows: DataFrame, n: int) -> DataFrame:
    """The first ``n`` rows by ordinal."""
    return rows.orderBy("ordinal").limit(n)


def found_first(wanted: DataFrame, rows: DataFrame, key: str = "RECORD_ID") -> DataFrame:
    """For each wanted key, its first row by ordinal: one join instead of a scan
    of the file for each."""
    first = rows.groupBy(key).agg(F.min_by(F.struct(*[c for c in rows.columns if c != key]), "ordinal").alias("_r"))
    return wanted.join(first, key).select(*wanted.columns, "_r.*")


def algorithm_name(path: Column, base_model: Column | None = None, model_type: Column | None = None) -> Column:
    """A model's name: the last part of its base model and its type if its
    configuration has both, else the last folder of its path."""
    tail = lambda c: F.try_element_at(F.split(F.regexp_replace(c, "/+$", ""), "/"), F.lit(-1))
    if base_model is None or model_type is None:
        return tail(path)
    both = F.concat_ws("-", tail(base_model), model_type)
    return F.when((F.coalesce(base_model, F.lit("")) != "") & (F.coalesce(model_type, F.lit("")) != ""), both).otherwise(tail(path))
