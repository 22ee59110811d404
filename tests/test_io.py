"""Sources, sinks and streams on temporary files."""

import bz2
import gzip
import json

from pyspark.sql import functions as F

from nomina.sources import readers, writers
from nomina.streaming import queue


def record(i, **more):
    return json.dumps({"DATA_SOURCE": "S", "RECORD_ID": f"r{i}", "RECORD_TYPE": "PERSON", "NAMES": [{"NAME_FULL": f"Имя {i}"}], **more}, ensure_ascii=False)


def test_json_lines(spark, tmp_path):
    lines = [record(1, PHONE="1") + ",", "", "{}", "{broken json here}", record(2)]
    (tmp_path / "a.jsonl").write_text("\n".join(lines))
    with gzip.open(tmp_path / "b.jsonl.gz", "wt") as f:
        f.write(record(3))
    with bz2.open(tmp_path / "c.jsonl.bz2", "wt") as f:
        f.write(record(4))
    got = readers.records(spark, str(tmp_path))
    assert sorted(r["RECORD_ID"] for r in got.collect()) == ["r1", "r2", "r3", "r4"]
    writers.raw_lines(got.filter("RECORD_ID = 'r1'"), str(tmp_path / "out"))
    back = spark.read.text(str(tmp_path / "out")).first()["value"]
    assert json.loads(back)["PHONE"] == "1" and "Имя" in back
    numbered = readers.lines(spark, str(tmp_path / "a.jsonl")).orderBy("ordinal").collect()
    assert [r["ordinal"] for r in numbered] == [1, 2, 3, 4, 5]


def test_lines_are_numbered_across_splits(spark, tmp_path):
    """Files of many splits, without a last line break, with empty lines."""
    texts = {"a.jsonl": "\n".join(f"line {i} " + "x" * (i % 50) if i % 7 else "" for i in range(3000)), "b.json": "one\r\ntwo\n", "c.jsonl": ""}
    for name, t in texts.items():
        (tmp_path / name).write_bytes(t.encode())
    with gzip.open(tmp_path / "d.jsonl.gz", "wt") as f:
        f.write("\n".join(map(str, range(500))))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        got = {}
        for r in readers.lines(spark, str(tmp_path)).collect():
            got.setdefault(r["file"].rsplit("/", 1)[-1], []).append((r["ordinal"], r["value"]))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    for name in ("a.jsonl", "b.json"):
        plain = texts[name].split("\n")
        plain = plain[:-1] if plain[-1] == "" else plain
        assert sorted(got[name]) == list(enumerate(plain, 1))
    assert sorted(got["d.jsonl.gz"]) == [(i + 1, str(i)) for i in range(500)] and "c.jsonl" not in got


def test_standard_input(spark):
    got = readers.standard_input(spark, iter(["a\n", "\n", "b"]), rows=2)
    assert [tuple(r) for r in got.orderBy("ordinal").collect()] == [(1, "a"), (2, ""), (3, "b")]
    assert readers.standard_input(spark, iter([])).count() == 0


def test_csv_and_reports(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,canonical,name,language\nQ1,"A ""x""","A, B",en\n')
    assert tuple(readers.alias_csv(spark, str(tmp_path / "a.csv")).first()) == ("Q1", 'A "x"', "A, B", "en")
    (tmp_path / "r").mkdir()
    (tmp_path / "r/one.json").write_text('{\n "model_path": "m",\n "n": 3\n}')
    (tmp_path / "r/two.json").write_text("{broken")
    assert [tuple(r) for r in readers.reports(spark, str(tmp_path / "r"), "model_path string, n int").collect()] == [("one.json", "m", 3)]


def test_load_and_dead_letters(spark, tmp_path):
    rows = spark.createDataFrame([("S", "a", None), ("S", "b", "too_long"), ("T", "c", None)], "data_source string, record_id string, error_type string")
    writers.load(rows, str(tmp_path / "ok"), str(tmp_path / "dead"))
    assert spark.read.parquet(str(tmp_path / "ok")).count() == 2
    assert spark.read.json(str(tmp_path / "dead")).first()["record_id"] == "b"
    writers.report(rows.agg(F.count("*").alias("n")), str(tmp_path / "report"))
    assert "".join(r["value"] for r in spark.read.text(str(tmp_path / "report")).collect()).replace(" ", "").replace("\n", "") == '{"n":3}'
    writers.purge(rows, str(tmp_path / "empty"))
    assert spark.read.parquet(str(tmp_path / "empty")).count() == 0
    assert writers.text_table(rows.orderBy("record_id")).splitlines()[1].startswith("S            a")


def test_streams(spark, tmp_path):
    tries = spark.createDataFrame([("a", "timed out"), ("b", None), ("c", "too long")], "record_id string, message string")
    tries.coalesce(1).write.parquet(str(tmp_path / "in"))
    got = []
    stream = queue.attempts(spark.readStream.schema(tries.schema).parquet(str(tmp_path / "in")))
    q = queue.drain(stream, lambda df, _: got.extend(tuple(r) for r in df.collect()), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert sorted(got) == [("a", 1, "retryable", "retry"), ("b", 1, None, "done"), ("c", 1, "too_long", "dead")]
    events = str(tmp_path / "events")
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").repartition(3).write.parquet(events)
    seen = []
    q = queue.drain(queue.deduplicated(queue.source(spark, events)), lambda df, _: seen.append(df.count()), str(tmp_path / "cp2"))
    q.awaitTermination(60)
    assert sum(seen) == spark.read.parquet(events).select("event_id").distinct().count()
    q = queue.running_tally(queue.source(spark, events)).writeStream.format("memory").queryName("tally").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("tally").agg(F.sum("n")).first()[0] == spark.read.parquet(events).count()


def test_ascii_json(spark, tmp_path):
    texts = ["plain", "Имя 日本", "\U0001f600 é\u0301", '"\\ \n', "", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    writers.json_lines(rows, str(tmp_path / "out"), ascii_only=True)
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert all(x.isascii() for x in lines)
    assert sorted((json.loads(x)["id"], json.loads(x).get("t")) for x in lines) == list(enumerate(texts))


def test_upsert(spark, tmp_path):
    path = str(tmp_path / "table")
    schema = "id string, v int, error_type string"
    load = lambda rows: dict(map(tuple, writers.upsert(spark.createDataFrame(rows, schema), path, "id", buckets=4).collect()))
    held = lambda: {r["id"]: r["v"] for r in spark.read.parquet(path).collect()}
    assert load([("a", 1, None), ("b", 2, None), ("c", 3, "other"), (None, 4, None)]) == {"a": "inserted", "b": "inserted", "c": "other", None: "no_key"}
    again = [("a", 9, None), ("c", 5, None), ("c", 6, None), ("d", 7, "too_long")]
    assert load(again) == {"a": "updated", "c": "inserted", "d": "too_long"}
    assert held() == {"a": 9, "b": 2, "c": 6}
    assert load(again)["c"] == "updated" and held() == {"a": 9, "b": 2, "c": 6}
    assert load([]) == {} and held() == {"a": 9, "b": 2, "c": 6}


def test_redo(spark, tmp_path):
    rows = spark.createDataFrame([("a", "timed out"), ("b", None), ("c", "bad"), ("d", None)], "record_id string, message string")
    rows.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    outcome = lambda df: df.select("record_id", F.when(F.col("message") == "bad", "other").when(F.col("message").isNotNull(), "retryable").alias("error_type"))
    said = []
    totals = queue.redo(stream(), outcome, str(tmp_path / "cp"), report=0.0, stuck=0.0, say=said.append)
    totals.query.awaitTermination(60)
    assert totals.outcomes == {"success": 2, "retryable": 1, "other": 1} and totals.batches == 2 and totals.rate() > 0
    assert sum("stuck" in x for x in said) == 2 and sum("messages" in x for x in said) == 2
    # Polled at a pace, an empty queue waits for more; a failure of the work ends it.
    polled = queue.redo(stream(), outcome, str(tmp_path / "cp2"), every="1 second")
    polled.query.processAllAvailable()
    assert polled.query.isActive and sum(polled.outcomes.values()) == 4
    rows.write.mode("append").parquet(str(tmp_path / "in"))
    polled.query.processAllAvailable()
    assert sum(polled.outcomes.values()) == 8
    polled.query.stop()
    failing = queue.redo(stream(), lambda df: df.select("nothing"), str(tmp_path / "cp3"))
    try:
        failing.query.awaitTermination(60)
    except Exception:
        pass
    assert failing.query.exception() is not None and not failing.outcomes
