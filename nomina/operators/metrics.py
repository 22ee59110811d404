"""Retrieval metrics: each an aggregation over one frame of results.

A result is a row of ``case_id, record_type, variant_type, query_name_type`` and,
for ``m`` in ``name, emb``: ``m_rank`` (null: not found), ``m_score, m_total,
m_ms``. Percentages are of all cases; ratios over nothing are null, never errors.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

KS = (1, 5, 10, 100)


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def percent(flag: Column) -> Column:
    """Share of rows where a flag is true, in percent; null counts as false."""
    return 100.0 * F.avg(F.when(flag, 1.0).otherwise(0.0))


def recall_at(rank: Column | str, k: int) -> Column:
    return percent(_c(rank) <= k)


def mrr_found(rank: Column | str) -> Column:
    """Mean reciprocal rank of the cases that were found."""
    return F.avg(1.0 / _c(rank))


def mrr_all(rank: Column | str) -> Column:
    """Mean reciprocal rank of all cases, 0 for those not found."""
    return F.avg(F.coalesce(1.0 / _c(rank), F.lit(0.0)))


def ndcg_at(rank: Column | str, k: int) -> Column:
    return F.avg(F.when(_c(rank) <= k, 1.0 / F.log2(_c(rank) + 1.0)).otherwise(0.0))


def retrieval(results: DataFrame, by: Iterable[str] = (), ks: tuple[int, ...] = KS) -> DataFrame:
    """Cases, recall@k, both MRRs, mean rank and not-found rate of both modes."""
    out = [F.count(F.lit(1)).alias("cases")]
    for m in ("name", "emb"):
        rank = F.col(f"{m}_rank")
        out += [recall_at(rank, k).alias(f"{m}_recall_{k}") for k in ks]
        out += [mrr_found(rank).alias(f"{m}_mrr_found"), mrr_all(rank).alias(f"{m}_mrr_all"), F.avg(rank).alias(f"{m}_mean_rank"), percent(rank.isNull()).alias(f"{m}_not_found")]
    return results.groupBy(*by).agg(*out)


def ndcg(results: DataFrame, by: Iterable[str] = (), ks: tuple[int, ...] = (5, 10, 20, 100)) -> DataFrame:
    return results.groupBy(*by).agg(*[ndcg_at(f"{m}_rank", k).alias(f"{m}_ndcg_{k}") for m in ("name", "emb") for k in ks])


#: Distinct values that a range is to hold, and the most ranges.
RANGE, RANGES = 50_000, 4096


def quantile_cuts(rows: DataFrame, value: str, n: int) -> list[float]:
    """``n`` ranges' bounds, by approximate quantiles."""
    return sorted(set(rows.approxQuantile(value, [i / n for i in range(1, n)], 1 / (2 * n)))) if n > 1 else []


def _same(left: DataFrame, right: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """Join on columns of the same names, where null equals null; a one-row right
    side without any."""
    if not by:
        return left.crossJoin(F.broadcast(right))
    right = right.withColumnsRenamed({c: f"_{c}_" for c in by})
    return left.join(right, [F.col(c).eqNullSafe(F.col(f"_{c}_")) for c in by], how).drop(*[f"_{c}_" for c in by])


def positions(rows: DataFrame, value: str, by: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """``by..., value, n, before``: for each distinct value of a group its rows
    and the group's rows with smaller ones. Values are counted first, so ties
    are one row however many they are; then they are ordered within ranges, whose
    number follows that of the values and whose totals, a small table, give the
    offsets. Null values take no part."""
    by = list(by)
    x = F.col(value).cast("double")
    counts = rows.filter(x.isNotNull()).groupBy(*by, x.alias("value")).agg(F.count(F.lit(1)).alias("n"))
    cuts = quantile_cuts(counts, "value", min(RANGES, 1 + counts.count() // RANGE))
    splits = [-math.inf, *cuts, math.inf]
    cells = Bucketizer(splits=splits if len(splits) > 2 else [-math.inf, 0.0, math.inf], inputCol="value", outputCol="_cell", handleInvalid="keep").transform(counts)
    totals = cells.groupBy(*by, "_cell").agg(F.sum("n").alias("_n"))
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("_n").over(earlier(Window.partitionBy(*by).orderBy("_cell"))), F.lit(0))
    both = _same(cells, totals.select(*by, "_cell", offset.alias("_offset")), [*by, "_cell"])
    inside = F.coalesce(F.sum("n").over(earlier(Window.partitionBy(*by, "_cell").orderBy("value"))), F.lit(0))
    return both.select(*by, "value", "n", (F.col("_offset") + inside).alias("before"))


def percentiles(rows: DataFrame, value: str, points: tuple[float, ...], by: Iterable[str] = ()) -> DataFrame:
    """Percentiles by linear interpolation, from counts by value; null where a
    group has no value."""
    by = list(by)
    run = positions(rows, value, by)
    total = run.groupBy(*by).agg(F.sum("n").alias("_all"))
    both = _same(run, total, by)
    at = lambda p: F.lit(p) * (F.col("_all") - 1)
    holds = lambda k: F.max(F.when((F.col("before") <= k) & (k < F.col("before") + F.col("n")), F.col("value")))
    ends = [x for i, p in enumerate(points) for x in (holds(F.floor(at(p))).alias(f"_low{i}"), holds(F.ceil(at(p))).alias(f"_high{i}"), F.max(at(p) - F.floor(at(p))).alias(f"_part{i}"))]
    found = both.groupBy(*by).agg(*ends)
    between = lambda i: F.col(f"_low{i}") + (F.col(f"_high{i}") - F.col(f"_low{i}")) * F.col(f"_part{i}")
    out = found.select(*by, *[between(i).alias(f"p{round(100 * p):02d}") for i, p in enumerate(points)])
    return _same(rows.select(*by).distinct(), out, by, "left") if by else out


def with_medians(report: DataFrame, rows: DataFrame, medians: dict[str, str], by: Iterable[str] = ()) -> DataFrame:
    """A report with the medians of columns of ``rows`` under the given names;
    ``by``: what both are grouped by. Null keys are a group."""
    by = list(by)
    for value, name in medians.items():
        report = _same(report, percentiles(rows, value, (0.5,), by).withColumnRenamed("p50", name), by, "left")
    return report


def floor_percentiles(rows: DataFrame, value: str, points: tuple[float, ...], by: Iterable[str] = ()) -> DataFrame:
    """Percentiles as the sorted value at place ``floor(p * n)`` from 0, null
    where there is none; groups without a value give no row. Places come from
    ``positions``, so no task orders a whole group."""
    by = list(by)
    run = positions(rows, value, by)
    both = _same(run, run.groupBy(*by).agg(F.sum("n").alias("_all")), by)
    place = lambda p: F.floor(F.lit(p) * F.col("_all"))
    holds = lambda k: F.max(F.when((F.col("before") <= k) & (k < F.col("before") + F.col("n")), F.col("value")))
    return both.groupBy(*by).agg(*[holds(place(p)).alias(f"p{round(100 * p):02d}") for p in points])


def describe(value: Column | str, name: str) -> list[Column]:
    """Mean, extremes and population deviation; ``with_medians`` adds medians."""
    v = _c(value)
    return [F.avg(v).alias(f"{name}_mean"), F.min(v).alias(f"{name}_min"), F.max(v).alias(f"{name}_max"), F.stddev_pop(v).alias(f"{name}_std")]


def relative_ranking(placed: DataFrame, by: Iterable[str] = ()) -> DataFrame:
    """Shares of the five scenarios (``scenario, positive_rank, negative_rank,
    total``), how often the positive leads, separation of ranks where both are
    found, mean ranks and mean number of hits."""
    s, p, n = F.col("scenario"), F.col("positive_rank"), F.col("negative_rank")
    names = ("both_found_correct_order", "both_found_wrong_order", "only_positive_found", "only_negative_found", "neither_found")
    by = list(by)
    report = placed.groupBy(*by).agg(
        *[percent(s == x).alias(x) for x in names],
        percent(s.isin("both_found_correct_order", "only_positive_found")).alias("positive_leads"),
        F.avg(n - p).alias("mean_separation"),
        F.avg(p).alias("mean_positive_rank"), F.avg(n).alias("mean_negative_rank"), F.avg("total").alias("mean_total"),
    )
    return with_medians(report, placed.withColumn("_apart", n - p), {"_apart": "median_separation"}, by)


def rescue(results: DataFrame, by: Iterable[str] = ()) -> DataFrame:
    """What embeddings find that names don't; the four rates compare rank 1."""
    g, e = F.coalesce(F.col("name_rank") == 1, F.lit(False)), F.coalesce(F.col("emb_rank") == 1, F.lit(False))
    lost, saved = F.col("name_rank").isNull(), F.col("name_rank").isNull() & F.col("emb_rank").isNotNull()
    return results.groupBy(*by).agg(
        F.count_if(lost).alias("name_failures"), F.count_if(saved).alias("rescued"),
        F.try_divide(100.0 * F.count_if(saved), F.count_if(lost)).alias("rescue_rate"),
        percent(g & e).alias("both_correct"), percent(g & ~e).alias("name_only_correct"), percent(~g & e).alias("emb_only_correct"), percent(~g & ~e).alias("neither_correct"),
    )


def impact(results: DataFrame, top: bool, by: Iterable[str] = ()) -> DataFrame:
    """Cases that embeddings gain and lose: found at all, or at rank 1 (``top``)."""
    at = (lambda c: F.coalesce(F.col(c) == 1, F.lit(False))) if top else (lambda c: F.col(c).isNotNull())
    g, e = at("name_rank"), at("emb_rank")
    return results.groupBy(*by).agg(
        F.count_if(e & ~g).alias("improved"), F.count_if(g & ~e).alias("degraded"),
        percent(e & ~g).alias("improvement_rate"), percent(g & ~e).alias("degradation_rate"),
    )


def guarded_corr(x: Column | str, y: Column | str) -> Column:
    """Pearson's r over rows where both are present; 0 where one is constant."""
    x, y = _c(x).cast("double"), _c(y).cast("double")
    x, y = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    return F.coalesce(F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)), F.lit(0.0))


def volume(results: DataFrame, mode: str = "emb") -> DataFrame:
    """How many hits come back, and whether more of them go with worse ranks."""
    total = F.col(f"{mode}_total")
    one = results.agg(F.avg(total).alias("mean_total"), F.min(total).alias("min_total"), F.max(total).alias("max_total"), guarded_corr(total, f"{mode}_rank").alias("total_rank_corr"))
    return with_medians(one, results, {f"{mode}_total": "median_total"})


def score_distributions(scores: DataFrame) -> DataFrame:
    """``positive_score, negative_score`` described, and how far means part."""
    both = describe("positive_score", "positive") + describe("negative_score", "negative")
    one = scores.agg(*both, (F.avg("positive_score") - F.avg("negative_score")).alias("separation"))
    return with_medians(one, scores, {"positive_score": "positive_median", "negative_score": "negative_median"})


def _at_or_above(scores: DataFrame, flags: dict[str, Column], values: Iterable[int]) -> DataFrame:
    """``threshold`` and, for each of ``flags``, how many rows with a ``score`` at
    or above it have the flag. Scores are counted before thresholds meet them."""
    counts = scores.groupBy(F.floor("score").alias("_s")).agg(*[F.count_if(f).alias(c) for c, f in flags.items()])
    cuts = F.broadcast(scores.sparkSession.createDataFrame([(v,) for v in values], "threshold int"))
    sums = [F.coalesce(F.sum(F.when(F.col("_s") >= F.col("threshold"), F.col(c))), F.lit(0)).alias(c) for c in flags]
    return cuts.join(counts, F.lit(True), "left").groupBy("threshold").agg(*sums)


def sweep_eval(scores: DataFrame, values: Iterable[int] = (50, 60, 65, 70, 75, 80)) -> DataFrame:
    """For each cut-off of the bucket "close": recall of positives, their share
    among all at or above it, and the other cut-offs that go with it."""
    t = F.col("threshold")
    both = scores.select(F.lit(True).alias("yes"), F.col("positive_score").alias("score")).unionByName(scores.select(F.lit(False).alias("yes"), F.col("negative_score").alias("score")))
    sums = _at_or_above(both, {"p": F.col("yes"), "n": ~F.col("yes")}, values)
    whole = F.broadcast(scores.agg(F.count("positive_score").alias("_all")))
    p, n = F.col("p"), F.col("n")
    swept = sums.crossJoin(whole).select("threshold", F.try_divide(100.0 * p, F.col("_all")).alias("recall"), F.coalesce(F.try_divide(100.0 * p, p + n), F.lit(0.0)).alias("positive_share"))
    return swept.select(
        "*", F.least(F.lit(100), t + 15).alias("same"), F.greatest(F.lit(20), t - 10).alias("likely"),
        F.greatest(F.lit(15), t - 20).alias("plausible"), F.greatest(F.lit(10), t - 30).alias("unlikely"),
    )


def recommend_eval(sweep: DataFrame) -> DataFrame:
    """balanced: the lowest cut-off with recall of 95 or more, else the last;
    conservative: the lowest above it with recall of 90 or more, else it."""
    t = F.col("threshold")
    one = sweep.agg(F.coalesce(F.min(F.when(F.col("recall") >= 95, t)), F.max(t)).alias("balanced"))
    both = sweep.crossJoin(F.broadcast(one))
    return both.groupBy("balanced").agg(F.coalesce(F.min(F.when((F.col("recall") >= 90) & (t > F.col("balanced")), t)), F.col("balanced")).alias("conservative"))


def sweep_prod(hits: DataFrame, values: Iterable[int] = range(50, 85, 5)) -> DataFrame:
    """Hits (``case_id, is_expected, score``) at each cut-off: true and false
    positives, recall of cases, precision, F1 and hits for each case."""
    cases = hits.select("case_id").distinct().agg(F.count(F.lit(1)).alias("cases"))
    sums = _at_or_above(hits, {"tp": F.col("is_expected"), "fp": ~F.col("is_expected")}, values)
    rows = sums.crossJoin(F.broadcast(cases))
    recall = F.coalesce(F.try_divide(100.0 * F.col("tp"), F.col("cases")), F.lit(0.0))
    precision = F.coalesce(F.try_divide(100.0 * F.col("tp"), F.col("tp") + F.col("fp")), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))
    return rows.select("threshold", "tp", "fp", recall.alias("recall"), precision.alias("precision"), f1.alias("f1"), F.try_divide((F.col("tp") + F.col("fp")).cast("double"), F.col("cases")).alias("volume"))


def recommend_prod(sweep: DataFrame) -> DataFrame:
    """balanced: best F1; conservative: best recall at precision of 90 or more,
    else best precision; aggressive: the lowest cut-off with recall of 90 or
    more, else the lowest. The lowest cut-off wins ties; other buckets follow."""
    t, r, p = F.col("threshold"), F.col("recall"), F.col("precision")
    best = lambda metric, where=F.lit(True): -F.max(F.when(where, F.struct(metric.alias("m"), (-t).alias("t"))))["t"]
    one = sweep.agg(
        best(F.col("f1")).alias("balanced"), F.coalesce(best(r, p >= 90), best(p)).alias("conservative"), F.coalesce(F.min(F.when(r >= 90, t)), F.min(t)).alias("aggressive")
    )
    rows = one.unpivot([], ["balanced", "conservative", "aggressive"], "profile", "close")
    c = F.col("close")
    return rows.select("profile", F.lit(100).alias("same"), c, F.greatest(c - 10, F.lit(50)).alias("likely"), F.greatest(c - 20, F.lit(40)).alias("plausible"), F.greatest(c - 30, F.lit(30)).alias("unlikely"))


def name_type(column: str = "query_name_type") -> tuple[Column, Column]:
    """A query name type's kind and script; both unknown without a separator."""
    parts = F.split(F.col(column), "_", 2)
    whole = F.size(parts) == 2
    return F.when(whole, parts[0]).otherwise("unknown"), F.when(whole, F.get(parts, F.lit(1))).otherwise("unknown")


def breakdown(results: DataFrame) -> DataFrame:
    """The same metrics by record type, by script and by name type in one pass,
    as grouping sets: ``dimension, value`` and the metrics."""
    kind, script = name_type()
    rows = results.withColumn("_kind", kind).withColumn("_script", script)
    sets = [[F.col("record_type")], [F.col("_script")], [F.col("_kind")]]
    grouped = rows.groupingSets(sets, "record_type", "_script", "_kind").agg(
        F.grouping_id().alias("_g"), F.count(F.lit(1)).alias("cases"),
        recall_at("name_rank", 1).alias("name_recall_1"), recall_at("emb_rank", 1).alias("emb_recall_1"),
        recall_at("name_rank", 10).alias("name_recall_10"), recall_at("emb_rank", 10).alias("emb_recall_10"),
        mrr_found("name_rank").alias("name_mrr"), mrr_found("emb_rank").alias("emb_mrr"),
    )
    names = F.element_at(F.create_map(F.lit(3), F.lit("record_type"), F.lit(5), F.lit("script"), F.lit(6), F.lit("name_type")), F.col("_g").cast("int"))
    value = F.when(F.col("_g") == 3, F.col("record_type")).when(F.col("_g") == 5, F.col("_script")).otherwise(F.col("_kind"))
    return grouped.select(names.alias("dimension"), value.alias("value"), "cases", *[c for c in grouped.columns if c.split("_")[0] in ("name", "emb")])


def by_variant(results: DataFrame, placed: DataFrame | None = None, mode: str = "emb", ks: tuple[int, ...] = KS) -> DataFrame:
    """Cases, found counts, accuracy, recall, mean reciprocal rank and times for
    each variant type; ``placed`` (as for ``relative_ranking``, with
    ``variant_type``) adds that block."""
    rank = f"{mode}_rank"
    report = results.groupBy("variant_type").agg(
        F.count(F.lit(1)).alias("cases"), F.count("name_rank").alias("name_found"), F.count("emb_rank").alias("emb_found"),
        recall_at("name_rank", 1).alias("name_accuracy"), recall_at("emb_rank", 1).alias("emb_accuracy"),
        *[recall_at(rank, k).alias(f"recall_{k}") for k in ks], mrr_found(rank).alias(f"{mode}_mrr"), F.avg(f"{mode}_ms").alias(f"{mode}_ms"),
    )
    times = percentiles(results, f"{mode}_ms", (0.5, 0.95), ["variant_type"]).withColumnsRenamed({"p50": f"{mode}_ms_p50", "p95": f"{mode}_ms_p95"})
    for more in (times, *([relative_ranking(placed, ["variant_type"])] if placed is not None else ())):
        report = _same(report, more, ["variant_type"], "left")
    return report


def sibling_recall(cases: DataFrame, top: DataFrame) -> DataFrame:
    """Cases (``case_id, aliases`` array of distinct or repeated labels) against
    their top hits (``case_id, label, distance``): percent of each case's
    aliases that are among the labels, counted by occurrence."""
    found = cases.select("case_id", F.explode("aliases").alias("label")).join(top.select("case_id", "label").distinct().withColumn("hit", F.lit(1)), ["case_id", "label"], "left")
    return found.groupBy("case_id").agg(F.try_divide(100.0 * F.count("hit"), F.count(F.lit(1))).alias("sibling_recall"))


def sibling_hits(cases: DataFrame, members: DataFrame, top: DataFrame) -> DataFrame:
    """``case_id, label, distance``: the top hits (``case_id, rank, label,
    distance``) of cases (``case_id, entity``) that are other members (``entity,
    id, label``) of the case's entity, each at its first place. Work follows the
    hits, not the sizes of entities; labels belong to one id."""
    first = top.groupBy("case_id", "label").agg(F.min_by("distance", "rank").alias("distance"))
    known = first.join(cases.select("case_id", "entity"), "case_id").join(members.select("label", "id", F.col("entity").alias("of")), "label")
    return known.filter("of = entity and id <> case_id").select("case_id", "label", "distance")


def sibling_shares(cases: DataFrame, members: DataFrame, top: DataFrame) -> DataFrame:
    """``sibling_recall`` from memberships (see ``sibling_hits``): siblings are
    counted by entity and never listed. Cases without a sibling are left out."""
    sizes = members.groupBy("entity").agg((F.count(F.lit(1)) - 1).alias("n"))
    found = sibling_hits(cases, members, top).groupBy("case_id").agg(F.count(F.lit(1)).alias("hits"))
    every = cases.select("case_id", "entity").join(sizes, "entity").filter("n > 0").join(found, "case_id", "left")
    return every.select("case_id", (100.0 * F.coalesce("hits", F.lit(0)) / F.col("n")).alias("sibling_recall"))


def sibling_report(recalls: DataFrame) -> DataFrame:
    """Over ``sibling_recall``: cases, mean, and how many are perfect."""
    perfect = F.col("sibling_recall") == 100
    return recalls.agg(F.count(F.lit(1)).alias("cases"), F.avg("sibling_recall").alias("mean_recall"), F.count_if(perfect).alias("perfect"), percent(perfect).alias("perfect_rate"))


def intra_distances(cases: DataFrame, top: DataFrame) -> DataFrame:
    """The distance of each alias found among a case's top hits, at its first
    place (``rank``)."""
    first = top.groupBy("case_id", "label").agg(F.min_by("distance", "rank").alias("distance"))
    return cases.select("case_id", F.explode("aliases").alias("label")).join(first, ["case_id", "label"]).select("case_id", "label", "distance")


def counted(rows: DataFrame, by: str) -> DataFrame:
    """Counts by a category and their percentage of all rows."""
    n = rows.groupBy(F.col(by).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("percent", F.try_divide(100.0 * F.col("n"), F.sum("n").over(Window.partitionBy(F.lit(1)))))
