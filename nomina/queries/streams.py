"""Streaming queries, drained to the end so that they compare with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import scratch
from ..streaming import progress, queue, timers
from .base import Query, rounded, table


def _events(spark, d):
    return queue.source(spark, d, only="events*.parquet")


def stream_tally(spark, d):
    """Outcomes by day of event time, in complete mode."""
    t = queue.drained(queue.running_tally(_events(spark, d), window="1 day"), "complete")
    return rounded(t.select(F.col("window.start").alias("day"), "outcome", "n", "mean_value"))


def stream_dedup(spark, d):
    """Each event read twice from the stream and kept once."""
    twice = _events(spark, d).withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(2))))
    out = queue.written(queue.deduplicated(twice, "3650 days").select("event_id", "user_id"), scratch(spark), scratch(spark))
    return out.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("event_id").alias("events"))


def stream_retry(spark, d):
    """A user's events as tries of one record, in three batches, so that a count
    of tries outlives its batch: what came of them."""
    path = scratch(spark)
    user = F.col("event_id") % 500
    message = F.when(user % 3 == 0, "operation timed out").when(user % 7 == 5, "too long")
    tries = table(spark, d, "events").select(user.cast("string").alias("record_id"), message.alias("message"), F.floor(F.col("event_id") / 1000).cast("long").alias("turn"))
    for part in range(3):
        tries.filter(f"turn % 3 = {part}").drop("turn").coalesce(1).write.mode("append").parquet(path)
    stream = queue.source(spark, path, "record_id string, message string", files=1)
    out = queue.written(queue.attempts(stream, most=3), scratch(spark), scratch(spark))
    return out.groupBy("action", "error_type").agg(F.count(F.lit(1)).alias("n"))


def _in_order(spark, d, rows, parts):
    """Rows with a ``part`` number as a folder of one file for each, in order."""
    path = scratch(spark)
    for part in range(parts):
        rows.filter(F.col("part") == part).drop("part").coalesce(1).write.mode("append").parquet(path)
    return path


def stuck_retries(spark, d):
    """A user's events as tries of one record, errors as failures to retry: what
    becomes of them if a try is waited for half a day, by day and action."""
    e = table(spark, d, "events").filter("user_id is not null and ts is not null").withColumn("ts", F.col("ts").cast("timestamp"))
    ends = e.agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    third = F.least(F.lit(2), F.floor(3 * (F.unix_millis("ts") - F.unix_millis("a")) / (1 + F.unix_millis("b") - F.unix_millis("a")))).cast("int")
    tries = e.crossJoin(F.broadcast(ends)).select(F.col("user_id").cast("string").alias("record_id"), "ts", F.col("event_id").alias("n"), F.when(F.col("event_type") == "error", "operation timed out").alias("message"), third.alias("part"))
    stream = queue.source(spark, _in_order(spark, d, tries, 3), "record_id string, ts timestamp, n bigint, message string", files=1)
    with timers.with_timers(spark):
        out = queue.written(timers.outcomes(stream, most=2, wait_seconds=WAIT, late="1 minute"), scratch(spark), scratch(spark))
    return out.groupBy(F.date_trunc("day", "at").alias("day"), "action", "tries").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("record_id").alias("records"))


def load_progress(spark, d):
    """Events loaded from four files, a batch each: what its progress table says."""
    e = table(spark, d, "events").withColumn("part", F.pmod("event_id", F.lit(4)).cast("int"))
    stream = queue.source(spark, _in_order(spark, d, e, 4), files=1).withColumn("error_type", F.when(F.col("event_type") == "error", "retryable"))
    told = progress.followed(progress.observed(stream), scratch(spark), scratch(spark), scratch(spark), expected=e.count())
    kept = told.select("batch", "rows", "done", (F.col("rate") > 0).alias("moving"), (F.col("seconds_left") >= 0).alias("told"), F.col("observed")["attempts"].alias("attempts"), F.col("observed")["failures"].alias("failures"))
    return kept


WAIT = 43_200

QUERIES = {
    "stream_tally": Query(stream_tally, "SELECT date_trunc('day', ts) AS day, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'ok' END AS outcome, count(*) AS n, round(avg(value), 6) AS mean_value FROM events GROUP BY ALL"),
    "stream_dedup": Query(stream_dedup, "SELECT user_id, count(*) AS n, count(*) AS events FROM events GROUP BY 1"),
    "stuck_retries": Query(stuck_retries, f"""WITH e AS (SELECT CAST(user_id AS VARCHAR) AS u, epoch_ms(ts) AS ms, event_id, event_type = 'error' AS failed FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
a AS (SELECT *, lag(ms) OVER w AS before, lag(failed) OVER w AS failed_before, lead(ms) OVER w AS after FROM e WINDOW w AS (PARTITION BY u ORDER BY ms, event_id)),
b AS (SELECT *, sum(CASE WHEN failed AND failed_before AND ms <= before + {WAIT * 1000} THEN 0 ELSE 1 END) OVER (PARTITION BY u ORDER BY ms, event_id) AS run FROM a),
c AS (SELECT *, row_number() OVER (PARTITION BY u, run ORDER BY ms, event_id) AS nth FROM b),
d AS (SELECT u, ms, after, CAST(CASE WHEN failed THEN (nth - 1) % 2 + 1 ELSE 1 END AS INTEGER) AS k, failed, nth FROM c),
p AS (SELECT *, lag(k) OVER w AS k_before, lag(failed) OVER w AS f_before, lag(ms) OVER w AS m_before FROM d WINDOW w AS (PARTITION BY u ORDER BY ms, k)),
x AS (SELECT u, ms, CASE WHEN NOT failed AND f_before AND k_before = 1 AND ms <= m_before + {WAIT * 1000} THEN 2 ELSE k END AS tries, CASE WHEN NOT failed THEN 'done' WHEN k = 2 THEN 'dead' ELSE 'retry' END AS action FROM p
UNION ALL SELECT u, ms + {WAIT * 1000}, 1, 'stuck' FROM d WHERE failed AND k = 1 AND (after IS NULL OR after > ms + {WAIT * 1000}) AND (after IS NOT NULL OR ms + {WAIT * 1000} <= (SELECT max(ms) - 60000 FROM e)))
SELECT date_trunc('day', epoch_ms(ms)) AS day, action, tries, count(*) AS n, count(DISTINCT u) AS records FROM x GROUP BY ALL"""),
    "load_progress": Query(load_progress, """WITH b AS (SELECT event_id % 4 AS batch, count(*) AS rows, count(*) FILTER (event_type = 'error') AS failures FROM events GROUP BY 1)
SELECT batch, rows, CAST(sum(rows) OVER (ORDER BY batch) AS BIGINT) AS done, true AS moving, true AS told, rows AS attempts, failures FROM b"""),
    "stream_retry": Query(stream_retry, """WITH u AS (SELECT event_id % 500 AS u, (event_id // 1000) % 3 AS turn FROM events),
k AS (SELECT u, CASE WHEN u % 3 = 0 THEN 'retryable' WHEN u % 7 = 5 THEN 'too_long' END AS kind, count(*) FILTER (turn = 0) AS a, count(*) FILTER (turn = 1) AS b, count(*) FILTER (turn = 2) AS c FROM u GROUP BY ALL),
s AS (SELECT *, CASE WHEN a >= 3 THEN 0 ELSE a END AS t1 FROM k), s2 AS (SELECT *, CASE WHEN b = 0 THEN t1 WHEN t1 + b >= 3 THEN 0 ELSE t1 + b END AS t2 FROM s),
r AS (SELECT *, least(a, 2) + greatest(0, least(t1 + b, 2) - t1) + greatest(0, least(t2 + c, 2) - t2) AS again FROM s2),
x AS (SELECT 'retry' AS action, kind AS error_type, CAST(sum(again) AS BIGINT) AS n FROM r WHERE kind = 'retryable' GROUP BY ALL
UNION ALL SELECT CASE WHEN kind IS NULL THEN 'done' ELSE 'dead' END, kind, CAST(sum(a + b + c - CASE WHEN kind = 'retryable' THEN again ELSE 0 END) AS BIGINT) FROM r GROUP BY ALL) SELECT * FROM x WHERE n > 0"""),
}
