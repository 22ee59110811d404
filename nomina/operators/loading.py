"""Loading with retries: classes of failure, dead letters, running tallies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

# An engine's and a database's codes for a value beyond its column.
TOO_LONG = "SENZ1001|22001"


def error_type(message: Column) -> Column:
    """too_long for values beyond a column's width, retryable for time-outs and
    lost connections, other for the rest; null without a message."""
    low = F.lower(message)
    return (
        F.when(message.isNull(), None)
        .when(low.contains("too long") | message.rlike(TOO_LONG), "too_long")
        .when(low.rlike("timeout|timed out|retryable|connection"), "retryable")
        .otherwise("other")
    )


def tally(attempts: DataFrame, kind: str = "error_type") -> DataFrame:
    """Attempts by outcome, successes as ``success``, and their percentage."""
    outcome = F.coalesce(F.col(kind), F.lit("success"))
    n = attempts.groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))
    total = n.agg(F.sum("n").alias("all_"))
    return n.crossJoin(F.broadcast(total)).select("outcome", "n", F.try_divide(100.0 * F.col("n"), F.col("all_")).alias("percent"))


def split_failures(failures: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Failures to try again, and dead letters."""
    again = F.coalesce(F.col("error_type") == "retryable", F.lit(False))
    return failures.filter(again), failures.filter(~again)


def final_outcomes(attempts: DataFrame, most: int = 3) -> DataFrame:
    """One row for each record of a log of attempts (``record_id, attempt,
    error_type``): tried at most ``most`` times, given up at once unless
    retryable; its last outcome and number of attempts."""
    tried = attempts.filter(F.col("attempt") <= most)
    stop = F.min(F.when(F.col("error_type").isNull() | (F.col("error_type") != "retryable"), F.col("attempt")))
    end = tried.groupBy("record_id").agg(F.coalesce(stop, F.max("attempt")).alias("attempts"))
    last = tried.join(end, "record_id").filter("attempt = attempts")
    return last.select("record_id", "attempts", F.coalesce("error_type", F.lit("success")).alias("outcome"))


def counts(records: DataFrame, business: DataFrame, names: DataFrame) -> DataFrame:
    """How many rows three tables have, in one row."""
    one = lambda d, c: d.agg(F.count(F.lit(1)).alias(c))
    return one(records, "records").crossJoin(one(business, "business_embeddings")).crossJoin(one(names, "name_embeddings"))


def observed(attempts: DataFrame, name: str = "load") -> tuple[DataFrame, Observation]:
    """``attempts`` unchanged, and running sums that are ready once an action has
    passed over them: records, failures, names and their mean."""
    seen = Observation(name)
    out = attempts.observe(seen, F.count(F.lit(1)).alias("records"), F.count("error_type").alias("failures"), F.sum("n_names").alias("names"), F.avg("n_names").alias("names_a_record"))
    return out, seen
