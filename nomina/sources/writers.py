"""Sinks: JSON lines, reports, parquet loads and dead letters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch


def escaped(text: Column) -> Column:
    """What lies beyond ASCII as JSON escapes, by UTF-16 units."""
    units = lambda c: F.hex(F.encode(c, "UTF-16BE"))
    one = lambda c: F.concat(F.lit("\\u"), F.substring(units(c), 1, 4), F.when(F.length(units(c)) > 4, F.concat(F.lit("\\u"), F.substring(units(c), 5, 4))).otherwise(""))
    # Runs of plain characters stay whole; others are taken one by one.
    parts = F.regexp_extract_all(text, F.lit(r"[\x00-\x7F]+|[^\x00-\x7F]"), F.lit(0))
    return F.array_join(F.transform(parts, lambda c: F.when(F.octet_length(c) == F.length(c), c).otherwise(F.lower(one(c)))), "")


def json_lines(rows: DataFrame, path: str, compression: str | None = None, ascii_only: bool = False) -> None:
    """One JSON object a line, in UTF-8 or all ASCII; null fields are left out."""
    if not ascii_only:
        rows.write.mode("overwrite").json(path, compression=compression)
        return
    lines = rows.select(escaped(F.to_json(F.struct(*rows.columns))).alias("value"))
    lines.write.mode("overwrite").text(path, compression=compression)


def raw_lines(rows: DataFrame, path: str, column: str = "raw") -> None:
    """Lines as they were read, so that unknown keys survive."""
    rows.select(F.col(column).alias("value")).write.mode("overwrite").text(path)


def report(rows: DataFrame, path: str) -> None:
    """A one-row frame as an indented JSON document."""
    one = rows.select(F.to_json(F.struct(*rows.columns), {"pretty": "true", "ignoreNullFields": "false"}).alias("value"))
    one.coalesce(1).write.mode("overwrite").text(path)


def load(attempts: DataFrame, path: str, dead_letters: str) -> None:
    """Records whose last attempt succeeded, by source; the others, with their
    class of failure, as dead letters. Overwrites, so a lost job can run again."""
    ok = F.col("error_type").isNull()
    attempts.filter(ok).drop("error_type").write.mode("overwrite").partitionBy("data_source").parquet(path)
    json_lines(attempts.filter(~ok), dead_letters)


def upsert(attempts: DataFrame, path: str, key: str, buckets: int = 64, order: str | None = None) -> DataFrame:
    """Bring records into a table by key and say what came of each: ``key,
    outcome``, which is inserted, updated or the attempt's ``error_type``.

    The table is partitioned by a hash of the key. Only the buckets that records
    fall into are read, merged and replaced, each as a whole, so a lost job can
    run again. Of attempts that share a key the last by the column ``order``, which
    is not stored, counts; without it, or where it ties, the largest row by value.
    Null keys fail as ``no_key``. An empty frame changes nothing."""
    spark = attempts.sparkSession
    kind = F.coalesce("error_type", F.when(F.col(key).isNull(), "no_key"))
    tried = attempts.withColumn("error_type", kind).withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    columns = [c for c in tried.columns if c not in ("error_type", "bucket", key, order)]
    last = F.max(F.struct(*([order] if order else []), F.struct(*columns).alias("_row"))).alias("_r")
    good = tried.filter("error_type is null").groupBy(key, "bucket").agg(last).select(key, "_r._row.*", "bucket")
    files = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = files.getFileSystem(spark._jsc.hadoopConfiguration()).exists(files)
    old = spark.read.schema(good.schema).parquet(path) if there else good.limit(0)
    known = old.select(key).withColumn("_had", F.lit(True))
    merged = old.join(F.broadcast(good.select("bucket").distinct()), "bucket", "left_semi").join(good.select(key), key, "left_anti").select(*good.columns).unionByName(good)
    outcome = F.coalesce("error_type", F.when(F.col("_had"), "updated").otherwise("inserted"))
    said = tried.join(known, key, "left").select(key, outcome.alias("outcome")).distinct()
    # What came of the attempts is written before the table changes.
    told = scratch(spark)
    said.write.parquet(told)
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    return spark.read.schema(said.schema).parquet(told)


def purge(template: DataFrame, path: str) -> None:
    """Empty a table and keep its schema."""
    template.limit(0).write.mode("overwrite").parquet(path)


def text_table(rows: DataFrame, n: int = 100) -> str:
    """A small frame as fixed-width text: at most ``n`` rows, for reports."""
    found = [[str(x) if x is not None else "-" for x in r] for r in rows.limit(n).collect()]
    widths = [max(map(len, c)) for c in zip(rows.columns, *found)]
    return "\n".join("  ".join(x.ljust(w) for x, w in zip(line, widths)).rstrip() for line in [rows.columns, *found])
