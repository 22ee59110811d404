"""Correlation and agreement of scores; pairs come as ``gnr_score, cosine_sim,
same_entity, pair_type``."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .metrics import describe, guarded_corr, positions, quantile_cuts, with_medians
from .ranking import average_rank, first_n

def both_present(pairs: DataFrame) -> DataFrame:
    return pairs.filter("gnr_score is not null and cosine_sim is not null")


def ranked(rows: DataFrame, value: str, out: str) -> DataFrame:
    """``rows`` with the average rank of ``value`` over all of them; ties have
    theirs from their count."""
    ranks = positions(rows, value).select(F.col("value").alias("_value"), (F.col("before") + (F.col("n") + 1) / 2.0).alias(out))
    return rows.join(ranks, F.col(value).cast("double") == F.col("_value")).drop("_value")


def pearson(pairs: DataFrame) -> DataFrame:
    one = both_present(pairs).agg(guarded_corr("gnr_score", "cosine_sim").alias("pearson"), F.count(F.lit(1)).alias("n"))
    return one.withColumn("p_value", correlation_p("pearson", "n"))


def spearman(pairs: DataFrame) -> DataFrame:
    rows = ranked(ranked(both_present(pairs).select("gnr_score", "cosine_sim"), "gnr_score", "rg"), "cosine_sim", "rc")
    one = rows.agg(guarded_corr("rg", "rc").alias("spearman"), F.count(F.lit(1)).alias("n"))
    return one.withColumn("p_value", correlation_p("spearman", "n"))


def concordance(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    """Sum over pairs of points of sign(dx) * sign(dy), each as often as its
    points' counts ``w`` say. Points are sorted by x and y; blocks of them are
    then merged, and a point meets those of the block before it by their sums."""
    order = np.lexsort((y, x))
    x, y, w = x[order], np.unique(y[order], return_inverse=True)[1], w[order].astype(float)
    n, span = len(x), int(y.max(initial=0)) + 1
    total, width = 0.0, 1
    while width < n:
        block = np.arange(n) // width
        left = block % 2 == 0
        key = (block // 2) * span + y
        at = np.flatnonzero(left)
        at = at[np.argsort(key[at], kind="stable")]
        sums = np.r_[0.0, np.cumsum(w[at])]
        mine = np.flatnonzero(~left)
        low, high = (np.searchsorted(key[at], key[mine], side) for side in ("left", "right"))
        first, last = (np.searchsorted(key[at], (block[mine] // 2 + k) * span) for k in (0, 1))
        total += float((w[mine] * ((sums[low] - sums[first]) - (sums[last] - sums[high]))).sum())
        width *= 2
    # Points of equal x came in order of y, and counted as concordant.
    same = np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if n else np.empty(0, int)
    point = np.flatnonzero(np.r_[True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])]) if n else same
    squares = lambda heads: float((np.add.reduceat(w, heads) ** 2).sum()) if n else 0.0
    return total - (squares(same) - squares(point)) / 2


def _cells(rows: DataFrame, value: str, n: int) -> Column:
    """A cell for each range of values, and one of its own for each bound; so
    frequent values, which are bounds, share theirs with no other."""
    cuts = quantile_cuts(rows, value, n)
    below = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col(value))) if cuts else F.lit(0)
    return (2 * below + (F.col(value).isin(cuts).cast("int") if cuts else 0)).cast("int")


def kendall(pairs: DataFrame, cell: int = 50_000) -> DataFrame:
    """Tau-b with its two-sided p-value (normal, with ties), from the counts of
    distinct points. Pairs of points in different ranges of both scores follow
    from a table of counts by range; those that share a range of either are
    counted within it, in a task that holds about ``cell`` points. Every pair is
    counted once and none is made."""
    points = both_present(pairs).groupBy(F.col("gnr_score").cast("double").alias("x"), F.col("cosine_sim").cast("double").alias("y")).agg(F.count(F.lit(1)).alias("n"))
    ranges = min(256, 1 + points.count() // cell)
    points = points.withColumn("i", _cells(points, "x", ranges)).withColumn("j", _cells(points, "y", ranges))

    def within(by: list[str], factor: int) -> DataFrame:
        """Pairs in one cell of ``by``; a cell of one value has none of weight."""
        solve = lambda t: pa.table({"s": pa.array([factor * concordance(*(t.column(c).to_numpy() for c in ("x", "y", "n")))])})
        mixed = points.filter(" and ".join(f"{c} % 2 = 0" for c in by))
        return mixed.groupBy(*by).applyInArrow(solve, "s double")

    table = points.groupBy("i", "j").agg(F.sum("n").alias("n"))

    def across(t: pa.Table) -> pa.Table:
        """Pairs whose cells differ in both, from at most 512 x 512 counts."""
        grid = np.zeros((2 * ranges, 2 * ranges))
        np.add.at(grid, (t.column("i").to_numpy(), t.column("j").to_numpy()), t.column("n").to_numpy())
        upto = np.zeros((2 * ranges + 1, 2 * ranges + 1))
        upto[1:, 1:] = grid.cumsum(axis=0).cumsum(axis=1)
        lower = upto[:-1, :-1]
        higher = upto[:-1, -1:] - upto[:-1, 1:]
        return pa.table({"s": pa.array([float((grid * (lower - higher)).sum())])})

    found = table.withColumn("whole", F.lit(1)).groupBy("whole").applyInArrow(across, "s double")
    for by, factor in ((["i"], 1), (["j"], 1), (["i", "j"], -1)):
        found = found.unionByName(within(by, factor))
    f = lambda m, *k: F.sum(m * (m - 1) * sum(k[1:], k[0])) if k else F.sum(m * (m - 1) / 2.0)

    def ties(c: str) -> DataFrame:
        m = F.col("m").cast("double")
        return points.groupBy(c).agg(F.sum("n").alias("m")).agg(f(m).alias(f"t{c}"), f(m, m - 2).alias(f"a{c}"), f(m, 2 * m + 5).alias(f"b{c}"))

    m = F.col("m").cast("double")
    whole = points.agg(F.sum("n").alias("m")).select(m.alias("m"), (m * (m - 1) / 2.0).alias("n0"))
    one = found.agg(F.sum("s").alias("s")).crossJoin(whole).crossJoin(ties("x")).crossJoin(ties("y"))
    pairs_of = m * (m - 1)
    spread = (pairs_of * (2 * m + 5) - F.col("bx") - F.col("by")) / 18 + 2 * F.col("tx") * F.col("ty") / pairs_of + F.col("ax") * F.col("ay") / (9 * pairs_of * (m - 2))
    tau = F.try_divide(F.coalesce("s", F.lit(0.0)), F.sqrt((F.col("n0") - F.col("tx")) * (F.col("n0") - F.col("ty"))))
    return one.select(tau.alias("kendall"), normal_p(F.try_divide(F.col("s"), F.sqrt(spread))).alias("p_value"))


@F.pandas_udf(T.DoubleType())
def normal_p(z: pd.Series) -> pd.Series:
    """Two-sided p-value of a normal score; for a report's one row."""
    return z.map(lambda v: None if pd.isna(v) else math.erfc(abs(v) / math.sqrt(2)))


def _beta_tail(x: float, a: float, b: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_tail(1 - x, b, a)
    front = math.exp(a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)) / a
    c, d, out = 1.0, 1 / max(1e-300, 1 - (a + b) * x / (a + 1)), 0.0
    out = d
    for k in range(1, 500):
        for step in (k * (b - k) * x / ((a + 2 * k - 1) * (a + 2 * k)), -(a + k) * (a + b + k) * x / ((a + 2 * k) * (a + 2 * k + 1))):
            d = 1 / (1 + step * d or 1e-300)
            c = 1 + step / c or 1e-300
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return min(1.0, front * out)


@F.pandas_udf(T.DoubleType())
def correlation_p(r: pd.Series, n: pd.Series) -> pd.Series:
    """Two-sided p-value of a correlation of ``n`` rows by Student's t with n - 2
    degrees of freedom; null below three rows. For a report's one row."""
    one = lambda v, m: None if pd.isna(v) or m < 3 else _beta_tail(1 - min(1.0, v * v), (m - 2) / 2, 0.5)
    return pd.Series([one(v, m) for v, m in zip(r, n)])


def roc_auc(rows: DataFrame, score: str, label: str) -> DataFrame:
    """Area under the curve by average ranks; 0.5 for a single class."""
    rows = ranked(rows.filter(F.col(score).isNotNull() & F.col(label).isNotNull()).select(F.col(score).cast("double").alias("s"), F.col(label).cast("boolean").alias("y")), "s", "r")
    sums = rows.agg(F.sum(F.when(F.col("y"), F.col("r"))).alias("r"), F.count_if(F.col("y")).alias("p"), F.count_if(~F.col("y")).alias("q"))
    area = F.try_divide(F.col("r") - F.col("p") * (F.col("p") + 1) / 2.0, (F.col("p") * F.col("q")).cast("double"))
    return sums.select(F.coalesce(area, F.lit(0.5)).alias("auc"), F.col("p").alias("positives"), F.col("q").alias("negatives"))


def grouped(pairs: DataFrame, by: str, value: str = "cosine_sim") -> DataFrame:
    return with_medians(pairs.groupBy(by).agg(F.count(F.lit(1)).alias("n"), *describe(value, "cos")), pairs, {value: "cos_median"}, [by])


def problem_cases(pairs: DataFrame) -> DataFrame:
    """Pairs on which vectors and names disagree, with the kind of it."""
    high = (F.col("cosine_sim") >= 0.70) & (F.col("gnr_score") < 50)
    low = (F.col("cosine_sim") < 0.50) & (F.col("gnr_score") >= 85)
    kind = F.when(high, "high_cosine_low_name").when(low, "low_cosine_high_name")
    return pairs.withColumn("problem", kind).filter("problem is not null")


def problem_report(pairs: DataFrame, order: list[str], most: int = 10) -> DataFrame:
    """``problem, n, percent, examples``: each kind's count, its percentage of
    the pairs that have both scores, and its first ``most`` pairs by ``order``;
    two rows, with 0 and no examples where a kind doesn't occur."""
    both = both_present(pairs)
    cases = problem_cases(both)
    shown = first_n(cases, ["problem"], order, most).groupBy("problem").agg(
        F.array_sort(F.collect_list(F.struct(*order, *(c for c in ("name_a", "name_b", "cosine_sim", "gnr_score", "same_entity") if c not in order)))).alias("examples")
    )
    counts = cases.groupBy("problem").agg(F.count(F.lit(1)).alias("n"))
    kinds = pairs.sparkSession.createDataFrame([("high_cosine_low_name",), ("low_cosine_high_name",)], "problem string")
    whole = F.broadcast(both.agg(F.count(F.lit(1)).alias("_all")))
    rows = kinds.join(counts, "problem", "left").join(shown, "problem", "left").crossJoin(whole)
    n = F.coalesce("n", F.lit(0)).cast("long")
    return rows.select("problem", n.alias("n"), F.try_divide(100.0 * n, F.col("_all")).alias("percent"), F.coalesce("examples", F.expr("array()")).alias("examples"))


def per_query_spearman(hits: DataFrame) -> DataFrame:
    """``case_id, spearman`` of queries with two hits or more,; constant scores have no value and drop out."""
    rows = hits.filter("gnr_score is not null and cosine is not null")
    r = rows.withColumn("rg", average_rank("gnr_score", ["case_id"])).withColumn("rc", average_rank("cosine", ["case_id"]))
    per = r.groupBy("case_id").agg(F.count(F.lit(1)).alias("n"), F.try_divide(F.covar_pop("rg", "rc"), F.stddev_pop("rg") * F.stddev_pop("rc")).alias("spearman"))
    return per.filter("n >= 2 and spearman is not null").select("case_id", "spearman")


def summarised(per: DataFrame, value: str = "spearman") -> DataFrame:
    one = per.agg(F.count(F.lit(1)).alias("queries"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.avg((F.col(value) > 0).cast("double")).alias("positive_rate"))
    return with_medians(one, per, {value: "median"})


def ranking_agreement(hits: DataFrame) -> DataFrame:
    """Over pairs of a query's hits (``case_id, ordinal``): do both scores order
    them alike? A tie is a pair that is equal in both; the rate is over the rest."""
    a, b = hits.alias("a"), hits.alias("b")
    x = F.signum((F.col("a.gnr_score") - F.col("b.gnr_score")).cast("double"))
    y = F.signum(F.col("a.cosine") - F.col("b.cosine"))
    pairs = a.join(b, (F.col("a.case_id") == F.col("b.case_id")) & (F.col("a.ordinal") < F.col("b.ordinal"))).select(x.alias("x"), y.alias("y"))
    tie = (F.col("x") == 0) & (F.col("y") == 0)
    sums = pairs.agg(F.count(F.lit(1)).alias("pairs"), F.count_if(tie).alias("ties"), F.count_if((F.col("x") == F.col("y")) & ~tie).alias("agreements"))
    return sums.withColumn("rate", F.try_divide(F.col("agreements").cast("double"), F.col("pairs") - F.col("ties")))


def best_alias(hits: DataFrame, names: int = 10) -> DataFrame:
    """Each entity's best cosine over its first names (``case_id, entity_id,
    nth, name, cosine``) and that name, the first on ties."""
    few = hits.filter(F.col("nth") < names)
    best = few.groupBy("case_id", "entity_id").agg(F.max(F.struct("cosine", (-F.col("nth")).alias("m"), "name")).alias("b"))
    return best.select("case_id", "entity_id", F.col("b.cosine").alias("cosine"), F.col("b.name").alias("name"))


def baseline_delta(current: DataFrame, baseline: DataFrame, metrics: list[str]) -> DataFrame:
    """Two one-row reports: each metric's values, change and change in percent,
    0 where the baseline is 0."""
    long = lambda d, out: d.select(*[F.col(m).cast("double").alias(m) for m in metrics]).unpivot([], metrics, "metric", out)
    both = long(current, "current").join(long(baseline, "baseline"), "metric")
    delta = F.col("current") - F.col("baseline")
    return both.select("metric", "current", "baseline", delta.alias("delta"), F.coalesce(100.0 * F.try_divide(delta, F.col("baseline")), F.lit(0.0)).alias("percent"))
