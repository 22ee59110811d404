"""A database table as a source, retries with timers, progress, stored indexes,
weighted draws and calibrated bytes."""

import sqlite3
from collections import Counter
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from nomina.functions import vectors
from nomina.operators import index, pairs, search
from nomina.sources import datasource
from nomina.streaming import progress, queue, timers

SCHEMA = "name string, id bigint"


@pytest.fixture
def database(tmp_path):
    path = str(tmp_path / "t.db")
    con = sqlite3.connect(path)
    con.execute('CREATE TABLE "my table" (id INTEGER PRIMARY KEY, name TEXT, other REAL)')
    con.executemany('INSERT INTO "my table" VALUES (?, ?, 1.5)', [(7 * i - 50, f"n{i}" if i % 5 else None) for i in range(200)])
    con.commit()
    con.close()
    return path


def add(path, rows):
    con = sqlite3.connect(path)
    con.executemany('INSERT INTO "my table" VALUES (?, ?, 0)', rows)
    con.commit()
    con.close()


def test_a_table_in_ranges(spark, database):
    t = datasource.keyed_table(spark, database, "my table", "id", SCHEMA)
    assert t.rdd.getNumPartitions() == 4
    assert sorted((r["id"], r["name"]) for r in t.collect()) == sorted((7 * i - 50, f"n{i}" if i % 5 else None) for i in range(200))
    sizes = t.groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) == 4 and max(s["count"] for s in sizes) < 60
    con = sqlite3.connect(database)
    con.execute('CREATE TABLE "none" (id INTEGER, name TEXT)')
    con.commit()
    con.close()
    assert datasource.keyed_table(spark, database, "none", "id", SCHEMA).count() == 0
    with pytest.raises(Exception, match="needs"):
        spark.read.format("keyed_table").schema(SCHEMA).option("path", database).load().count()


def test_a_queue_goes_on_after_a_stop(spark, database, tmp_path):
    out, at = str(tmp_path / "out"), str(tmp_path / "at")

    def drain():
        stream = datasource.keyed_stream(spark, database, "my table", "id", SCHEMA, rows=60)
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", at).trigger(processingTime="0 seconds").start()
        query.processAllAvailable()
        query.stop()
        return sorted(r["id"] for r in spark.read.parquet(out).collect())

    assert drain() == [7 * i - 50 for i in range(200)]
    add(database, [(5000 + i, "later") for i in range(70)])
    assert drain() == [7 * i - 50 for i in range(200)] + [5000 + i for i in range(70)]


def test_retries_with_timers(spark, tmp_path):
    start = datetime(2024, 1, 1)
    at = lambda minutes: start + timedelta(minutes=minutes)
    timeout = "operation timed out"
    log = [
        [("a", at(0), 0, timeout), ("b", at(1), 0, timeout), ("c", at(2), 0, None), ("d", at(3), 0, timeout), ("d", at(4), 0, timeout), ("d", at(5), 0, timeout)],
        [("a", at(8), 0, None), ("e", at(9), 0, "too long"), (None, at(9), 0, None), ("f", None, 0, None), ("z", at(40), 0, None)],
        [("b", at(50), 0, None), ("g", at(51), 0, timeout), ("z", at(120), 0, None)],
    ]
    folder = str(tmp_path / "in")
    for part in log:
        spark.createDataFrame(part, "record_id string, ts timestamp, n bigint, message string").coalesce(1).write.mode("append").parquet(folder)
    stream = queue.source(spark, folder, "record_id string, ts timestamp, n bigint, message string", files=1)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    with timers.with_timers(spark):
        got = queue.written(timers.outcomes(stream, most=3, wait_seconds=600), str(tmp_path / "out"), str(tmp_path / "at")).collect()
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before
    minutes = lambda r: (r["at"] - start).total_seconds() / 60
    assert sorted((r["record_id"], minutes(r), r["tries"], r["error_type"], r["action"]) for r in got) == sorted([
        ("a", 0, 1, "retryable", "retry"), ("a", 8, 2, None, "done"), ("b", 1, 1, "retryable", "retry"), ("b", 11, 1, "retryable", "stuck"), ("b", 50, 1, None, "done"), ("c", 2, 1, None, "done"),
        ("d", 3, 1, "retryable", "retry"), ("d", 4, 2, "retryable", "retry"), ("d", 5, 3, "retryable", "dead"), ("e", 9, 1, "too_long", "dead"),
        ("g", 51, 1, "retryable", "retry"), ("g", 61, 1, "retryable", "stuck"), ("z", 40, 1, None, "done"), ("z", 120, 1, None, "done"),
    ])


def test_progress_sums_to_the_input(spark, tmp_path):
    folder = str(tmp_path / "in")
    for n in (10, 20, 5):
        spark.range(n).select(F.col("id").alias("event_id"), F.when(F.col("id") % 5 == 0, "retryable").alias("error_type")).coalesce(1).write.mode("append").parquet(folder)
    stream = progress.observed(queue.source(spark, folder, "event_id bigint, error_type string", files=1))
    told = progress.followed(stream, str(tmp_path / "out"), str(tmp_path / "told"), str(tmp_path / "at"), expected=70).orderBy("batch").collect()
    assert [r["rows"] for r in told] == [10, 20, 5] and [r["done"] for r in told] == [10, 30, 35]
    assert [r["observed"]["failures"] for r in told] == [2, 4, 1] and all(r["rate"] > 0 and r["seconds_left"] == pytest.approx((70 - r["done"]) / r["rate"]) for r in told)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 35


def test_stored_index(spark, tmp_path):
    r = np.random.default_rng(1)
    centres = r.normal(size=(8, 16))
    x = centres[r.integers(8, size=600)] + 0.2 * r.normal(size=(600, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    t = spark.createDataFrame([(i, i % 3, v.tolist()) for i, v in enumerate(x)] + [(900, 1, None), (None, 1, x[0].tolist())], "id long, entity long, v array<double>")
    path, q = str(tmp_path / "index"), t.filter("id < 40")
    index.build(t, path, cells=8, parts=4)
    found, told = index.searched(q, path, 5, probes=2, again=8, parts=4)
    exact = search.neighbours(q, t, 5)
    assert search.recall(found, exact).first()["recall"] > 0.9
    told = told.first()
    assert told["rows"] == 40 * 600 and told["codes"] <= told["rows"] / 2 and told["vectors"] == 40 * 40
    every = index.search(q, path, 5, probes=8, again=200, parts=4)
    same = lambda df: sorted((r["query_id"], r["rank"], r["feat_id"]) for r in df.collect())
    assert same(every) == same(exact)
    scan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "cell" in scan
    with pytest.raises(ValueError):
        index.build(t.limit(0), path)
    with pytest.raises(ValueError):
        index.build(t, path, parts=5)


def test_negatives_come_as_often_as_the_pool_has_them(spark):
    pool = spark.createDataFrame([("e1", "own", 40)] + [("e2", "often", 60), ("e2", "seldom", 5), ("e3", "other", 35), (None, "x", 9), ("e4", None, 9)], "entity string, name string, n int")
    pool = pool.select("entity", "name", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy"))
    rows = spark.range(1500).select(F.col("id").cast("string").alias("k"), F.lit("e1").alias("entity"))
    got = pairs.draw_weighted(rows, ["k"], pool, "entity", "name", 2, 42)
    counts = Counter(r["negative"] for r in got.collect())
    assert sum(counts.values()) == 3000 and "own" not in counts and None not in counts
    for name, share in (("often", 0.6), ("seldom", 0.05), ("other", 0.35)):
        assert abs(counts[name] / 3000 - share) < 4 * (share * (1 - share) / 3000) ** 0.5
    alone = pairs.draw_weighted(rows.limit(3), ["k"], pool.filter("entity = 'e1'"), "entity", "name", 2, 42)
    assert alone.count() == 0


def test_bytes(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(200, 6)) * [1, 10, 0.1, 1, 0, 5]
    t = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(500, None)], "id long, v array<double>")
    scales = vectors.int8_scales(t, "v", "id")
    assert scales == pytest.approx([m / 127 if m else 1 for m in np.abs(x).max(axis=0)])
    packed = t.select("id", vectors.to_int8(F.col("v"), scales).alias("p")).withColumn("back", vectors.from_int8(F.col("p"), scales)).withColumn("dot", vectors.int8_dot("p", "p"))
    for row in packed.collect():
        if row["id"] == 500:
            assert row["p"] is None and row["back"] is None and row["dot"] is None
        else:
            q = np.frombuffer(row["p"], np.int8).astype(int)
            assert len(q) == 6 and row["dot"] == int(q @ q) and np.abs(np.array(row["back"]) - x[row["id"]]).max(initial=0) <= 0.5001 * max(scales)
    far = spark.createDataFrame([(1, [1e9, -1e9, 0.0, 0.0, 0.0, 0.0])], "id long, v array<double>").select(vectors.to_int8(F.col("v"), scales).alias("p")).first()["p"]
    assert list(np.frombuffer(far, np.int8)) == [127, -127, 0, 0, 0, 0]


def test_steps_reach_the_largest_of_all_rows(spark):
    t = spark.range(30_000).select("id", F.array(*[((F.col("id") * k) % 30_000).cast("double") for k in (1, 7, 11, 13, 17, 19, 23, 29)]).alias("v"))
    assert vectors.int8_scales(t, "v", "id") == [29_999 / 127] * 8


def test_a_small_negative_number_keeps_its_sign(spark):
    got = spark.createDataFrame([(-1e-9,), (1e-9,), (-0.25,), (None,)], "x double").select(vectors.rounded(F.col("x"), 6).alias("x")).collect()
    assert [str(r["x"]) for r in got] == ["-0.0", "0.0", "-0.25", "None"]


def test_an_index_of_full_cells(spark, tmp_path):
    """Bytes must tell a cell's rows apart when it has many more than are looked at
    by their vectors."""
    r = np.random.default_rng(4)
    x = np.concatenate([np.eye(2)[r.integers(2, size=4000)] * 3, r.normal(size=(4000, 30)) / 30**0.5], axis=1) / 10**0.5
    t = spark.createDataFrame([(i, 0, v.tolist()) for i, v in enumerate(x)], "id long, entity long, v array<double>")
    path, q = str(tmp_path / "index"), t.filter("id < 50")
    index.build(t, path, cells=2)
    found = index.search(q, path, 10, probes=1, again=8)
    assert search.recall(found, search.neighbours(q, t, 10)).first()["recall"] > 0.9
