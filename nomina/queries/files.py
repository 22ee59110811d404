"""Sources and sinks: tables go out to files or a queue and come back."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..functions.vectors import dense, pool
from ..operators import loading
from ..session import scratch
from ..sources import readers, writers
from ..streaming import queue
from .base import Query, aliases, rounded, table


def read_lines(spark, d):
    """Documents as lines, numbered in each file without gaps."""
    path = scratch(spark)
    docs = table(spark, d, "documents").filter("doc_id is not null")
    writers.raw_lines(docs.withColumn("raw", F.concat_ws(":", "doc_id", F.coalesce("n_chars", F.lit(0)))), path)
    found = readers.lines(spark, path)
    dense = found.groupBy("file").agg((F.max("ordinal") == F.count_distinct("ordinal")).alias("numbered"))
    return found.join(F.broadcast(dense), "file").select("value", "numbered")


def strict_json(spark, d):
    """JSON lines that must parse, through a compressed file."""
    path = scratch(spark)
    docs = table(spark, d, "documents").select("doc_id", "lang", F.md5("text").alias("digest"))
    writers.json_lines(docs, path, compression="gzip")
    return readers.decoded(readers.scanned(spark, path), schema="doc_id bigint, lang string, digest string", tolerant=False).drop("raw", "value")


def ascii_json(spark, d):
    """JSON lines with everything beyond ASCII escaped: no byte above 127 is left,
    and texts come back whole."""
    path = scratch(spark)
    docs = table(spark, d, "documents").select("doc_id", "text")
    writers.json_lines(docs, path, ascii_only=True)
    lines = readers.scanned(spark, path)
    plain = F.length("value") == F.octet_length("value")
    return readers.decoded(lines.withColumn("plain", plain), schema="doc_id bigint, text string", tolerant=False).select("doc_id", F.md5("text").alias("digest"), "plain")


def alias_file(spark, d):
    """An alias file with quotes, commas and line breaks in its fields."""
    path = scratch(spark)
    docs = table(spark, d, "documents").filter("doc_id is not null")
    rows = docs.select(F.concat(F.lit("Q"), "doc_id").alias("id"), F.concat(F.lit('The "'), F.coalesce("source", F.lit("-")), F.lit('", Ltd.')).alias("canonical"), F.concat(F.lit("a\nb, "), F.coalesce("lang", F.lit("-"))).alias("name"), F.coalesce("lang", F.lit("-")).alias("language"))
    rows.write.csv(path, header=True, quote='"', escape='"', mode="overwrite")
    return readers.alias_csv(spark, path)


def report_file(spark, d):
    """A report written as an indented document and found again."""
    path = scratch(spark)
    writers.report(table(spark, d, "documents").agg(F.count(F.lit(1)).alias("documents"), F.count_distinct("lang").alias("languages"), F.max("lang").alias("last")), path)
    return readers.reports(spark, path, "documents bigint, languages bigint, last string").drop("source_file")


def embedding_file(spark, d):
    path = scratch(spark)
    a = aliases(spark, d)
    a.select(F.col("id").alias("feat_id"), F.col("name").alias("label"), F.col("v").alias("embedding"), F.lit(1).alias("more")).write.parquet(path)
    found = readers.embedding_table(spark, path)
    return found.select("feat_id", "label", F.round(F.element_at("embedding", 1).cast("double"), 6).alias("first"), F.size("embedding").alias("dim"))


def upserted(spark, d):
    """Two loads of events by user: later values replace earlier ones, failures
    change nothing, and a load that is run again changes nothing more. The first
    load has all of a user's events, of which the earliest is to stay."""
    path = scratch(spark)
    e = table(spark, d, "events").select(F.col("user_id").cast("string").alias("record_id"), "event_id", "value")
    first = e.withColumn("turn", -F.col("event_id")).drop("event_id")
    last = e.groupBy("record_id").agg(F.max_by("value", "event_id").alias("value"), F.max("event_id").alias("event_id"))
    fails = F.when(F.col("event_id") % 5 == 0, "too_long")
    outcomes = [writers.upsert(first.filter("record_id % 3 <> 0").withColumn("error_type", F.lit(None).cast("string")), path, "record_id", order="turn")]
    tries = last.filter("record_id % 2 = 0").withColumn("error_type", fails).drop("event_id")
    for _ in range(2):
        outcomes.append(writers.upsert(tries, path, "record_id"))
    found = spark.read.parquet(path).select("record_id", F.round("value", 6).alias("value"))
    return found.join(outcomes[1].select("record_id", "outcome"), "record_id", "left").select("record_id", "value", F.coalesce("outcome", F.lit("untouched")).alias("outcome"))


def purged(spark, d):
    """A table's rows before and after it is emptied, and its columns."""
    path = scratch(spark)
    writers.purge(table(spark, d, "region"), path)
    return spark.read.parquet(path).agg(F.count(F.lit(1)).alias("after")).withColumn("columns", F.lit(len(spark.read.parquet(path).columns)))


def observed_sums(spark, d):
    """Running sums of a load, ready after its one pass."""
    rows = table(spark, d, "events").select(F.when(F.col("event_id") % 7 == 0, "too_long").alias("error_type"), (F.col("event_id") % 4).alias("n_names"))
    passing, seen = loading.observed(rows)
    passing.write.format("noop").mode("overwrite").save()
    got = seen.get
    return spark.createDataFrame([(got["records"], got["failures"], got["names"], round(got["names_a_record"], 6))], "records long, failures long, names long, names_a_record double")


def pooled_vectors(spark, d):
    """Vectors as eight tokens of eight parts, those of small numbers masked:
    pooled by mean or by the first, then through a dense layer."""

    def run(parts):
        weight = (np.arange(64).reshape(8, 8) % 5 - 2) / 4
        for part in parts:
            tokens = np.stack(part["v"]).astype(float).reshape(-1, 8, 8)
            mask = (np.arange(8)[None, :] <= (part["id"].to_numpy() % 8)[:, None]).astype(int)
            mean, first = (pool(tokens, mask, first=f) for f in (False, True))
            made = dense(mean, weight, np.full(8, 0.1))
            plain = dense(mean, weight, np.full(8, 0.1), tanh=False)
            yield pd.DataFrame({"id": part["id"], "mean_1": mean[:, 0], "first_8": first[:, 7], "dense_3": made[:, 2], "linear_3": plain[:, 2]})

    return rounded(aliases(spark, d).select("id", "v").mapInPandas(run, "id long, mean_1 double, first_8 double, dense_3 double, linear_3 double"))


def redo_queue(spark, d):
    """A queue drained in batches, with what came of its messages."""
    path = scratch(spark)
    rows = table(spark, d, "events").select(F.col("event_id").cast("string").alias("record_id"), F.when(F.col("event_id") % 9 == 0, "connection lost").when(F.col("event_id") % 11 == 0, "bad").alias("message"))
    rows.repartition(4).write.parquet(path)
    stream = queue.source(spark, path, "record_id string, message string", files=1)
    totals = queue.redo(stream, lambda df: df.select("record_id", loading.error_type(F.col("message")).alias("error_type")), scratch(spark))
    totals.query.awaitTermination(600)
    return spark.createDataFrame([(k, v) for k, v in sorted(totals.outcomes.items())], "outcome string, n long")


def _one(v: str) -> str:
    """The pooled mean's parts, as SQL."""
    return f"list_transform(range(1, 9), lambda j: list_sum(list_transform(range(0, 1 + {v}.id % 8), lambda k: {v}.v[8 * k + j])) / (1 + {v}.id % 8))"


_LINEAR = "0.1 + list_sum(list_transform(range(1, 9), lambda j: m[j] * ((16 + j - 1) % 5 - 2) / 4.0))"

QUERIES = {
    "read_lines": Query(read_lines, "SELECT doc_id || ':' || coalesce(n_chars, 0) AS value, true AS numbered FROM documents WHERE doc_id IS NOT NULL"),
    "strict_json": Query(strict_json, "SELECT doc_id, lang, md5(text) AS digest FROM documents"),
    "ascii_json": Query(ascii_json, "SELECT doc_id, md5(text) AS digest, true AS plain FROM documents"),
    "alias_file": Query(alias_file, "SELECT 'Q' || doc_id AS id, 'The \"' || coalesce(source, '-') || '\", Ltd.' AS canonical, 'a' || chr(10) || 'b, ' || coalesce(lang, '-') AS name, coalesce(lang, '-') AS language FROM documents WHERE doc_id IS NOT NULL"),
    "report_file": Query(report_file, "SELECT count(*) AS documents, count(DISTINCT lang) AS languages, max(lang) AS last FROM documents"),
    "embedding_file": Query(embedding_file, "SELECT vec_id AS feat_id, 'n' || vec_id AS label, round(CAST(embedding[1] AS DOUBLE), 6) AS first, CAST(len(embedding) AS INTEGER) AS dim FROM embeddings"),
    "upserted": Query(upserted, """WITH f AS (SELECT CAST(user_id AS VARCHAR) AS record_id, user_id, arg_min(value, event_id) AS a, arg_max(value, event_id) AS b, max(event_id) AS e FROM events WHERE user_id IS NOT NULL GROUP BY ALL),
s AS (SELECT *, user_id % 3 <> 0 AS had, user_id % 2 = 0 AS tried, user_id % 2 = 0 AND e % 5 <> 0 AS ok FROM f)
SELECT record_id, round(CASE WHEN ok THEN b ELSE a END, 6) AS value, CASE WHEN NOT tried THEN 'untouched' WHEN NOT ok THEN 'too_long' WHEN had THEN 'updated' ELSE 'inserted' END AS outcome FROM s WHERE had OR ok"""),
    "purged": Query(purged, "SELECT 0 AS after, count(*) AS columns FROM (DESCRIBE region)"),
    "observed_sums": Query(observed_sums, "SELECT count(*) AS records, count(*) FILTER (event_id % 7 = 0) AS failures, CAST(sum(event_id % 4) AS BIGINT) AS names, round(avg(event_id % 4), 6) AS names_a_record FROM events"),
    "pooled_vectors": Query(pooled_vectors, f"""WITH a AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), p AS (SELECT id, v, {_one("a")} AS m FROM a)
SELECT id, round(m[1], 6) AS mean_1, round(v[8], 6) AS first_8, round((exp(2 * ({_LINEAR})) - 1) / (exp(2 * ({_LINEAR})) + 1), 6) AS dense_3, round({_LINEAR}, 6) AS linear_3 FROM p"""),
    "redo_queue": Query(redo_queue, "SELECT CASE WHEN event_id % 9 = 0 THEN 'retryable' WHEN event_id % 11 = 0 THEN 'other' ELSE 'success' END AS outcome, count(*) AS n FROM events GROUP BY 1"),
}
