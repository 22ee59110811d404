"""Ranking and retrieval metric queries."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..operators import comparison, lexical, metrics, ranking, search, stats
from ..plans import pipelines
from ..session import checkpoint
from .base import HITS, WITH_ALIASES, WITH_HITS, WITH_RESULTS, Query, aliases, expected, hits, results, rounded, table
from .resolution import graded

KS, NS = metrics.KS, (5, 10, 20, 100)


def rank_by_score(spark, d):
    return ranking.ranked(hits(spark, d)).select("case_id", "mode", "ordinal", "entity_id", ranking.score().alias("score"), "rank")


def rank_by_ordinal(spark, d):
    return ranking.ranked(hits(spark, d), "ordinal").select("case_id", "mode", "ordinal", "entity_id", "rank")


def _placed(spark, d, by="ordinal"):
    p = ranking.placed(ranking.ranked(hits(spark, d), by), expected(spark, d))
    return p.withColumn("scenario", ranking.scenario(F.col("positive_rank"), F.col("negative_rank")))


def first_nonpositive(spark, d):
    return _placed(spark, d, "score").select("case_id", "mode", "positive_rank", "negative_rank", F.col("positive_score").cast("int").alias("positive_score"), "total")


def scenario(spark, d):
    return _placed(spark, d).groupBy("mode", "scenario").agg(F.count(F.lit(1)).alias("n"))


def relative_ranking(spark, d):
    return rounded(metrics.relative_ranking(_placed(spark, d), ["mode"]))


def recall_at_k(spark, d):
    r = results(spark, d)
    return rounded(r.agg(*[metrics.recall_at(f"{m}_rank", k).alias(f"{m}_{k}") for m in ("name", "emb") for k in KS]))


def mrr_found(spark, d):
    return rounded(results(spark, d).agg(*[metrics.mrr_found(f"{m}_rank").alias(m) for m in ("name", "emb")]))


def mrr_all(spark, d):
    return rounded(results(spark, d).agg(*[metrics.mrr_all(f"{m}_rank").alias(m) for m in ("name", "emb")]))


def ndcg_at_k(spark, d):
    return rounded(metrics.ndcg(results(spark, d)))


def retrieval_report(spark, d):
    return rounded(metrics.retrieval(results(spark, d)))


def _searched(spark, d):
    """Every embedding with a short name searched among all others, both ways."""
    a = aliases(spark, d).withColumn("name", F.concat(F.lit("w"), (F.col("id") % 97).cast("string"), F.lit(" w"), (F.col("id") % 89).cast("string")))
    return lexical.searched_results(a, a, 0.3, 0.2, None)


def searched_retrieval(spark, d):
    return rounded(metrics.retrieval(checkpoint(_searched(spark, d))))


def searched_rescue(spark, d):
    found = checkpoint(_searched(spark, d))
    return rounded(metrics.rescue(found).drop("rescue_rate").crossJoin(metrics.impact(found, top=False)))


def rescue(spark, d):
    return rounded(metrics.rescue(results(spark, d)))


def impact_found(spark, d):
    return rounded(metrics.impact(results(spark, d), top=False))


def impact_rank1(spark, d):
    return rounded(metrics.impact(results(spark, d), top=True))


def volume_corr(spark, d):
    return rounded(metrics.volume(results(spark, d)))


def pctl_linear(spark, d):
    return rounded(metrics.percentiles(table(spark, d, "events"), "value", (0.05, 0.5, 0.95, 0.99), ["event_type"]))


def pctl_floor(spark, d):
    return rounded(metrics.floor_percentiles(table(spark, d, "events"), "value", (0.5, 0.95, 0.99), ["event_type"]))


def latency_stats(spark, d):
    events = table(spark, d, "events")
    return rounded(metrics.with_medians(events.groupBy("event_type").agg(*metrics.describe("value", "ms")), events, {"value": "ms_median"}, ["event_type"]))


def _scores(spark, d):
    return results(spark, d).select(F.col("emb_score").alias("positive_score"), F.col("name_score").alias("negative_score"))


def score_distributions(spark, d):
    return rounded(metrics.score_distributions(_scores(spark, d)))


def threshold_sweep_eval(spark, d):
    return rounded(metrics.sweep_eval(_scores(spark, d)))


def recommend_eval(spark, d):
    return metrics.recommend_eval(metrics.sweep_eval(_scores(spark, d), range(5, 85, 5)))


def _judged(spark, d):
    h = hits(spark, d).filter("mode = 'emb'").join(expected(spark, d), "case_id")
    return h.select("case_id", (F.col("entity_id") == F.col("expected_entity_id")).alias("is_expected"), ranking.score().alias("score"))


def threshold_sweep_prod(spark, d):
    return rounded(metrics.sweep_prod(_judged(spark, d)))


def recommend_prod(spark, d):
    return metrics.recommend_prod(metrics.sweep_prod(_judged(spark, d)))


def breakdown_grouping_sets(spark, d):
    return rounded(metrics.breakdown(results(spark, d)))


def by_variant(spark, d):
    types = table(spark, d, "events").select(F.expr(HITS["case_id"]).alias("case_id"), F.col("event_type").alias("variant_type"), "event_id")
    first = types.groupBy("case_id").agg(F.min_by("variant_type", "event_id").alias("variant_type"))
    placed = _placed(spark, d).filter("mode = 'emb'").join(first, "case_id")
    return rounded(metrics.by_variant(results(spark, d), placed))


def full_report(spark, d):
    return rounded(pipelines.full_report(results(spark, d), _placed(spark, d)))


def rank_histogram(spark, d):
    both = results(spark, d).selectExpr("name_rank as name", "emb_rank as emb").unpivot([], ["name", "emb"], "mode", "rank")
    return both.groupBy("mode", ranking.rank_bucket(F.col("rank")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def query_name_types(spark, d):
    kind, script = metrics.name_type()
    return results(spark, d).groupBy(kind.alias("kind"), script.alias("script")).agg(F.count(F.lit(1)).alias("n"))


def mode_pairing(spark, d):
    """Both modes' places of each case side by side."""
    cases = expected(spark, d).join(hits(spark, d).select("case_id").distinct(), "case_id")
    return pipelines.validate(cases, hits(spark, d)).select("case_id", "expected_entity_id", "name_rank", "name_total", "emb_rank", "emb_total")


def response_flatten(spark, d):
    """Search responses as JSON, made of the hits and taken apart again."""
    h = hits(spark, d).filter("mode = 'emb'")
    feature = lambda c: F.array(F.struct(F.col(c).alias("SCORE")))
    scores = F.struct(feature("gnr_score").alias("NAME"), F.when(F.col("ordinal") % 2 == 0, feature("emb_score")).alias("NAME_EMBEDDING"), F.when(F.col("ordinal") % 2 == 1, feature("emb_score")).alias("BIZNAME_EMBEDDING"))
    entity = F.when(F.col("entity_id") != 3, F.col("entity_id"))
    made = F.struct(F.struct(F.struct(entity.alias("ENTITY_ID")).alias("RESOLVED_ENTITY")).alias("ENTITY"), F.struct(scores.alias("FEATURE_SCORES")).alias("MATCH_INFO"))
    docs = h.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", made.alias("e")))).alias("a"))
    json = docs.select("case_id", F.to_json(F.struct(F.transform("a", lambda x: x["e"]).alias("RESOLVED_ENTITIES"))).alias("response"))
    return ranking.flatten(json)


def embedding_contribution(spark, d):
    return ranking.contribution(hits(spark, d).withColumn("retrieved", F.col("ordinal") % 3 != 0))


def _top(spark, d):
    a = aliases(spark, d)
    found = search.neighbours(a.filter("id % 10 = 0"), a, k=20, decimals=6)
    return found.select(F.col("query_id").alias("case_id"), F.col("rank"), F.concat(F.lit("n"), F.col("feat_id").cast("string")).alias("label"), F.round(1.0 - F.col("cosine"), 6).alias("distance"))


def _siblings(spark, d):
    """Every tenth embedding, all of them, and the nearest of the former."""
    a = aliases(spark, d).select("id", "entity", F.col("name").alias("label"))
    return a.filter("id % 10 = 0").select(F.col("id").alias("case_id"), "entity"), a, _top(spark, d)


def sibling_recall(spark, d):
    return rounded(metrics.sibling_shares(*_siblings(spark, d)))


def intra_distance(spark, d):
    found = checkpoint(metrics.sibling_hits(*_siblings(spark, d)))
    report = metrics.with_medians(found.agg(F.count(F.lit(1)).alias("n"), *metrics.describe("distance", "distance")), found, {"distance": "distance_median"})
    return rounded(report.crossJoin(F.broadcast(metrics.percentiles(found, "distance", (0.95,)))))


def sibling_report(spark, d):
    return rounded(metrics.sibling_report(metrics.sibling_shares(*_siblings(spark, d))))


def _reports(spark, d):
    """A report for each variant type and half of the cases."""
    r = results(spark, d).withColumn("test_set", F.col("variant_type")).withColumn("model_type", F.when(F.col("record_type") == "PERSON", "personal").otherwise("business")).withColumn("model_path", F.concat(F.lit("/models/m"), (F.col("case_id") % 4).cast("string"), F.lit("/")))
    g = r.groupBy("test_set", "model_type", "model_path").agg(F.round(metrics.recall_at("emb_rank", 1), 6).alias("emb_accuracy"), F.round(metrics.ndcg_at("emb_rank", 10), 6).alias("n"))
    return g.withColumn("emb_ndcg", F.create_map(F.lit("10"), F.col("n"))).drop("n")


def compare_models(spark, d):
    c = comparison.compared(_reports(spark, d))
    return rounded(c.withColumn("model", comparison.model_name(F.col("model_path"))).drop("model_path"))


def best_models(spark, d):
    return comparison.best_models(_reports(spark, d)).select("test_set", "model_type", "model_path", "emb_accuracy")


def compare_validations(spark, d):
    r = results(spark, d).withColumn("run", F.concat(F.lit("/out/run"), (F.col("case_id") % 3).cast("string"), F.lit("/model.onnx")))
    g = metrics.retrieval(r, ["run"])
    biz = F.when(F.col("run").contains("run0"), None).otherwise(F.col("run"))
    return rounded(g.select(comparison.model_id(biz, F.col("run")).alias("model"), comparison.model_id(F.lit(""), F.lit(None).cast("string")).alias("none"), "cases", "name_recall_1", "emb_recall_1", (F.col("emb_recall_1") - F.col("name_recall_1")).alias("gain")))


def baseline_delta(spark, d):
    r = results(spark, d)
    one = lambda half: metrics.retrieval(r.filter(F.col("case_id") % 2 == half)).withColumn("zero", F.lit(half).cast("double"))
    return rounded(stats.baseline_delta(one(1), one(0), ["name_mrr_found", "emb_mrr_found", "emb_recall_1", "zero"]))


# SQL.
def _pct(cond: str) -> str:
    return f"round(100 * avg(CASE WHEN {cond} THEN 1.0::DOUBLE ELSE 0 END), 6)"


def _mrr(rank: str) -> str:
    return f"round(avg(1.0::DOUBLE / {rank}), 6)"


def _all(rank: str) -> str:
    return f"round(avg(coalesce(1.0::DOUBLE / {rank}, 0)), 6)"


def _ndcg(rank: str, k: int) -> str:
    return f"round(avg(CASE WHEN {rank} <= {k} THEN 1.0::DOUBLE / log2({rank} + 1.0::DOUBLE) ELSE 0 END), 6)"


def _stats(v: str, n: str) -> str:
    return f"round(avg({v}), 6) AS {n}_mean, round(CAST(median({v}) AS DOUBLE), 6) AS {n}_median, min({v}) AS {n}_min, max({v}) AS {n}_max, round(stddev_pop({v}), 6) AS {n}_std"


def _corr(x: str, y: str) -> str:
    return f"round(coalesce(covar_pop({x}, {y}) / nullif(stddev_pop({x}) FILTER ({y} IS NOT NULL) * stddev_pop({y}) FILTER ({x} IS NOT NULL), 0), 0), 6)"


_SCORE = "coalesce(emb_score, gnr_score, 0)"
_R = f"WITH {WITH_RESULTS} SELECT "
WITH_SEARCHED = f"""{WITH_ALIASES}, n AS (SELECT id, entity, v, 'w' || id % 97 AS p, 'w' || id % 89 AS q, 'w' || id % 97 || ' w' || id % 89 AS name FROM aliases),
m AS (SELECT a.id AS case_id, b.id, b.entity, a.name AS x, b.name AS y, len(list_intersect([a.p, a.q], [b.p, b.q])) / len(list_distinct([a.p, a.q, b.p, b.q]))::DOUBLE AS jaccard FROM n a JOIN n b ON a.id <> b.id AND (a.p IN (b.p, b.q) OR a.q IN (b.p, b.q))),
k AS (SELECT x, y FROM m WHERE jaccard >= 0.3), {graded("k")},
h AS (SELECT case_id, 'name' AS mode, entity, max(score) AS score FROM m JOIN graded USING (x, y) WHERE jaccard >= 0.3 GROUP BY ALL
UNION ALL SELECT a.id, 'emb', b.entity, max(CAST(floor(100 * list_dot_product(a.v, b.v) + 1e-6) AS INTEGER)) FROM n a JOIN n b ON a.id <> b.id WHERE list_dot_product(a.v, b.v) >= 0.2 GROUP BY ALL),
o AS (SELECT *, CAST(row_number() OVER (PARTITION BY case_id, mode ORDER BY score DESC, entity) AS INTEGER) AS rank FROM h),
results AS (SELECT n.id AS case_id, max(rank) FILTER (mode = 'name' AND o.entity = n.entity) AS name_rank, max(rank) FILTER (mode = 'emb' AND o.entity = n.entity) AS emb_rank FROM n LEFT JOIN o ON o.case_id = n.id GROUP BY n.id)"""
_RANKED = f"WITH {WITH_HITS}, r AS (SELECT *, {_SCORE} AS score, CAST(row_number() OVER (PARTITION BY case_id, mode ORDER BY {{order}}) AS INTEGER) AS rank FROM hits)"
_BY_SCORE, _BY_ORDINAL = _RANKED.format(order=f"{_SCORE} DESC, ordinal"), _RANKED.format(order="ordinal")
_PLACED = """, p AS (SELECT case_id, mode, min(CASE WHEN entity_id = expected_entity_id THEN rank END) AS positive_rank, min(CASE WHEN entity_id <> expected_entity_id THEN rank END) AS negative_rank,
  arg_min(coalesce(nullif(emb_score, 0), gnr_score, 0), rank) FILTER (entity_id = expected_entity_id) AS positive_score, count(*) AS total FROM r JOIN expected USING (case_id) GROUP BY case_id, mode),
s AS (SELECT *, CASE WHEN positive_rank < negative_rank THEN 'both_found_correct_order' WHEN positive_rank IS NOT NULL AND negative_rank IS NOT NULL THEN 'both_found_wrong_order'
  WHEN positive_rank IS NOT NULL THEN 'only_positive_found' WHEN negative_rank IS NOT NULL THEN 'only_negative_found' ELSE 'neither_found' END AS scenario FROM p) """
_SCENARIOS = ("both_found_correct_order", "both_found_wrong_order", "only_positive_found", "only_negative_found", "neither_found")
_KIND = "CASE WHEN contains(query_name_type, '_') THEN split_part(query_name_type, '_', 1) ELSE 'unknown' END"
_SCRIPT = "CASE WHEN contains(query_name_type, '_') THEN substr(query_name_type, strpos(query_name_type, '_') + 1) ELSE 'unknown' END"
_BUCKET = "CASE WHEN {0} IS NULL THEN 'not_found' WHEN {0} <= 1 THEN '1' WHEN {0} <= 5 THEN '2-5' WHEN {0} <= 10 THEN '6-10' WHEN {0} <= 50 THEN '11-50' WHEN {0} <= 100 THEN '51-100' ELSE '>100' END"


def _sweep_eval(values) -> str:
    rows = ", ".join(f"({v})" for v in values)
    return f"""WITH {WITH_RESULTS}, t(threshold) AS (VALUES {rows}), g AS (SELECT threshold, count(*) FILTER (emb_score >= threshold) AS p, count(*) FILTER (name_score >= threshold) AS n, count(emb_score) AS m FROM results, t GROUP BY threshold),
w AS (SELECT threshold, round(100.0::DOUBLE * p / m, 6) AS recall, round(coalesce(100.0::DOUBLE * p / nullif(p + n, 0), 0), 6) AS positive_share, least(100, threshold + 15) AS same, greatest(20, threshold - 10) AS likely, greatest(15, threshold - 20) AS plausible, greatest(10, threshold - 30) AS unlikely FROM g) """


_SWEEP_PROD = f"""WITH {WITH_HITS}, j AS (SELECT case_id, entity_id = expected_entity_id AS ok, {_SCORE} AS score FROM hits JOIN expected USING (case_id) WHERE mode = 'emb'),
t(threshold) AS (VALUES {", ".join(f"({v})" for v in range(50, 85, 5))}), n AS (SELECT count(DISTINCT case_id) AS cases FROM j),
g AS (SELECT threshold, count(*) FILTER (score >= threshold AND ok) AS tp, count(*) FILTER (score >= threshold AND NOT ok) AS fp FROM j, t GROUP BY threshold),
m AS (SELECT threshold, tp, fp, cases, 100.0::DOUBLE * tp / cases AS recall, coalesce(100.0::DOUBLE * tp / nullif(tp + fp, 0), 0) AS precision FROM g, n),
w AS (SELECT threshold, tp, fp, recall, precision, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1, CAST(tp + fp AS DOUBLE) / cases AS volume FROM m) """
_SIDE = "SELECT case_id, min(CASE WHEN entity_id = expected_entity_id THEN rank END) AS rank, count(*) AS total FROM r JOIN expected USING (case_id) WHERE mode = '{0}' GROUP BY case_id"
_TOP = f"""WITH {WITH_ALIASES}, c AS (SELECT q.id AS case_id, t.name AS label, t.id AS feat_id, round(list_dot_product(q.v, t.v), 6) AS cosine FROM aliases q JOIN aliases t ON q.id <> t.id WHERE q.id % 10 = 0),
top AS (SELECT case_id, label, round(1 - cosine, 6) AS distance, row_number() OVER (PARTITION BY case_id ORDER BY cosine DESC, feat_id) AS rank FROM c QUALIFY rank <= 20),
sib AS (SELECT q.id AS case_id, t.name AS label FROM aliases q JOIN aliases t ON q.entity = t.entity AND q.id <> t.id WHERE q.id % 10 = 0),
f AS (SELECT sib.case_id, sib.label, top.distance FROM sib LEFT JOIN top USING (case_id, label)) """
_REPORTS = f"""WITH {WITH_RESULTS}, g AS (SELECT variant_type AS test_set, CASE WHEN record_type = 'PERSON' THEN 'personal' ELSE 'business' END AS model_type, '/models/m' || (case_id % 4) || '/' AS model_path, {_pct("emb_rank <= 1")} AS emb_accuracy, {_ndcg("emb_rank", 10)} AS ndcg_10 FROM results GROUP BY ALL) """


def _retrieval(*names: str) -> str:
    cols = {"cases": "count(*)"}
    for m in ("name", "emb"):
        cols |= {f"{m}_recall_{k}": _pct(f"{m}_rank <= {k}") for k in KS}
        cols |= {f"{m}_mrr_found": _mrr(f"{m}_rank"), f"{m}_mrr_all": _all(f"{m}_rank"), f"{m}_mean_rank": f"round(avg({m}_rank), 6)", f"{m}_not_found": _pct(f"{m}_rank IS NULL")}
    return ", ".join(f"{e} AS {c}" for c, e in cols.items() if not names or c in names)


def _impact(g: str, e: str) -> str:
    return _R + f"count(*) FILTER ({e} AND NOT {g}) AS improved, count(*) FILTER ({g} AND NOT {e}) AS degraded, {_pct(f'{e} AND NOT {g}')} AS improvement_rate, {_pct(f'{g} AND NOT {e}')} AS degradation_rate FROM results"


_G, _E = "coalesce(name_rank = 1, false)", "coalesce(emb_rank = 1, false)"
_GROUP = ", ".join(f"{e} AS {c}" for c, e in {"cases": "count(*)", "name_recall_1": _pct("name_rank <= 1"), "emb_recall_1": _pct("emb_rank <= 1"), "name_recall_10": _pct("name_rank <= 10"), "emb_recall_10": _pct("emb_rank <= 10"), "name_mrr": _mrr("name_rank"), "emb_mrr": _mrr("emb_rank")}.items())
_BEST = "(SELECT threshold FROM w {0} LIMIT 1)"
_DELTA = ("name_mrr_found", "emb_mrr_found", "emb_recall_1", "zero")

QUERIES = {
    "rank_by_score": Query(rank_by_score, _BY_SCORE + " SELECT case_id, mode, ordinal, entity_id, score, rank FROM r"),
    "rank_by_ordinal": Query(rank_by_ordinal, _BY_ORDINAL + " SELECT case_id, mode, ordinal, entity_id, rank FROM r"),
    "first_nonpositive": Query(first_nonpositive, _BY_SCORE + _PLACED + "SELECT case_id, mode, positive_rank, negative_rank, positive_score, total FROM p"),
    "scenario": Query(scenario, _BY_ORDINAL + _PLACED + "SELECT mode, scenario, count(*) AS n FROM s GROUP BY mode, scenario"),
    "relative_ranking": Query(relative_ranking, _BY_ORDINAL + _PLACED + "SELECT mode, " + ", ".join(f"{_pct(f'''scenario = '{x}' ''')} AS {x}" for x in _SCENARIOS) + f""", {_pct("scenario IN ('both_found_correct_order', 'only_positive_found')")} AS positive_leads,
  round(avg(negative_rank - positive_rank), 6) AS mean_separation, round(median(negative_rank - positive_rank), 6) AS median_separation, round(avg(positive_rank), 6) AS mean_positive_rank, round(avg(negative_rank), 6) AS mean_negative_rank, round(avg(total), 6) AS mean_total FROM s GROUP BY mode"""),
    "recall_at_k": Query(recall_at_k, _R + ", ".join(f"{_pct(f'{m}_rank <= {k}')} AS {m}_{k}" for m in ("name", "emb") for k in KS) + " FROM results"),
    "mrr_found": Query(mrr_found, _R + f"{_mrr('name_rank')} AS name, {_mrr('emb_rank')} AS emb FROM results"),
    "mrr_all": Query(mrr_all, _R + f"{_all('name_rank')} AS name, {_all('emb_rank')} AS emb FROM results"),
    "ndcg_at_k": Query(ndcg_at_k, _R + ", ".join(f"{_ndcg(f'{m}_rank', k)} AS {m}_ndcg_{k}" for m in ("name", "emb") for k in NS) + " FROM results"),
    "searched_retrieval": Query(searched_retrieval, f"WITH RECURSIVE {WITH_SEARCHED} SELECT " + _retrieval() + " FROM results"),
    "searched_rescue": Query(searched_rescue, f"""WITH RECURSIVE {WITH_SEARCHED} SELECT count(*) FILTER (name_rank IS NULL) AS name_failures, count(*) FILTER (name_rank IS NULL AND emb_rank IS NOT NULL) AS rescued,
  {_pct(f"{_G} AND {_E}")} AS both_correct, {_pct(f"{_G} AND NOT {_E}")} AS name_only_correct, {_pct(f"NOT {_G} AND {_E}")} AS emb_only_correct, {_pct(f"NOT {_G} AND NOT {_E}")} AS neither_correct,
  count(*) FILTER (name_rank IS NULL AND emb_rank IS NOT NULL) AS improved, count(*) FILTER (name_rank IS NOT NULL AND emb_rank IS NULL) AS degraded,
  {_pct("name_rank IS NULL AND emb_rank IS NOT NULL")} AS improvement_rate, {_pct("name_rank IS NOT NULL AND emb_rank IS NULL")} AS degradation_rate FROM results"""),
    "retrieval_report": Query(retrieval_report, _R + _retrieval() + " FROM results"),
    "rescue": Query(rescue, _R + f"""count(*) FILTER (name_rank IS NULL) AS name_failures, count(*) FILTER (name_rank IS NULL AND emb_rank IS NOT NULL) AS rescued,
  round(100.0::DOUBLE * count(*) FILTER (name_rank IS NULL AND emb_rank IS NOT NULL) / count(*) FILTER (name_rank IS NULL), 6) AS rescue_rate,
  {_pct(f"{_G} AND {_E}")} AS both_correct, {_pct(f"{_G} AND NOT {_E}")} AS name_only_correct, {_pct(f"NOT {_G} AND {_E}")} AS emb_only_correct, {_pct(f"NOT {_G} AND NOT {_E}")} AS neither_correct FROM results"""),
    "impact_found": Query(impact_found, _impact("(name_rank IS NOT NULL)", "(emb_rank IS NOT NULL)")),
    "impact_rank1": Query(impact_rank1, _impact(_G, _E)),
    "volume_corr": Query(volume_corr, _R + f"round(avg(emb_total), 6) AS mean_total, round(CAST(median(emb_total) AS DOUBLE), 6) AS median_total, min(emb_total) AS min_total, max(emb_total) AS max_total, {_corr('emb_total', 'emb_rank')} AS total_rank_corr FROM results"),
    "pctl_linear": Query(pctl_linear, "SELECT event_type, " + ", ".join(f"round(quantile_cont(value, {p}), 6) AS p{round(100 * p):02d}" for p in (0.05, 0.5, 0.95, 0.99)) + " FROM events GROUP BY event_type"),
    "pctl_floor": Query(pctl_floor, "SELECT event_type, " + ", ".join(f"round(list_sort(list(value))[1 + CAST(floor({p} * count(value)) AS BIGINT)], 6) AS p{round(100 * p):02d}" for p in (0.5, 0.95, 0.99)) + " FROM events WHERE value IS NOT NULL GROUP BY event_type"),
    "latency_stats": Query(latency_stats, f"SELECT event_type, {_stats('round(value, 9)', 'ms')} FROM events GROUP BY event_type"),
    "score_distributions": Query(score_distributions, _R + f"{_stats('emb_score', 'positive')}, {_stats('name_score', 'negative')}, round(avg(emb_score) - avg(name_score), 6) AS separation FROM results"),
    "threshold_sweep_eval": Query(threshold_sweep_eval, _sweep_eval((50, 60, 65, 70, 75, 80)) + "SELECT * FROM w"),
    "recommend_eval": Query(recommend_eval, _sweep_eval(range(5, 85, 5)) + ", b AS (SELECT coalesce(min(threshold) FILTER (recall >= 95), max(threshold)) AS balanced FROM w) SELECT balanced, coalesce((SELECT min(threshold) FROM w WHERE recall >= 90 AND threshold > balanced), balanced) AS conservative FROM b"),
    "threshold_sweep_prod": Query(threshold_sweep_prod, _SWEEP_PROD + "SELECT threshold, tp, fp, round(recall, 6) AS recall, round(precision, 6) AS precision, round(f1, 6) AS f1, round(volume, 6) AS volume FROM w"),
    "recommend_prod": Query(recommend_prod, _SWEEP_PROD + f""", c AS (SELECT 'balanced' AS profile, {_BEST.format("ORDER BY f1 DESC, threshold")} AS close
  UNION ALL SELECT 'conservative', coalesce({_BEST.format("WHERE precision >= 90 ORDER BY recall DESC, threshold")}, {_BEST.format("ORDER BY precision DESC, threshold")})
  UNION ALL SELECT 'aggressive', coalesce((SELECT min(threshold) FROM w WHERE recall >= 90), (SELECT min(threshold) FROM w)))
SELECT profile, 100 AS same, close, greatest(close - 10, 50) AS likely, greatest(close - 20, 40) AS plausible, greatest(close - 30, 30) AS unlikely FROM c"""),
    "breakdown_grouping_sets": Query(breakdown_grouping_sets, f"WITH {WITH_RESULTS} " + " UNION ALL ".join(f"SELECT '{n}' AS dimension, {e} AS value, {_GROUP} FROM results GROUP BY {e}" for n, e in (("record_type", "record_type"), ("script", _SCRIPT), ("name_type", _KIND)))),
    "by_variant": Query(by_variant, _BY_ORDINAL + f", {WITH_RESULTS}" + _PLACED + f""", v AS (SELECT {HITS["case_id"]} AS case_id, arg_min(event_type, event_id) AS variant_type FROM events GROUP BY 1),
q AS (SELECT s.*, v.variant_type FROM s JOIN v USING (case_id) WHERE mode = 'emb'), w AS (SELECT variant_type, """ + ", ".join(f"{_pct(f'''scenario = '{x}' ''')} AS {x}" for x in _SCENARIOS) + f""", {_pct("scenario IN ('both_found_correct_order', 'only_positive_found')")} AS positive_leads,
  round(avg(negative_rank - positive_rank), 6) AS mean_separation, round(CAST(median(negative_rank - positive_rank) AS DOUBLE), 6) AS median_separation, round(avg(positive_rank), 6) AS mean_positive_rank, round(avg(negative_rank), 6) AS mean_negative_rank, round(avg(total), 6) AS mean_total FROM q GROUP BY variant_type),
u AS (SELECT variant_type, count(*) AS cases, count(name_rank) AS name_found, count(emb_rank) AS emb_found, {_pct('name_rank <= 1')} AS name_accuracy, {_pct('emb_rank <= 1')} AS emb_accuracy, {", ".join(f"{_pct(f'emb_rank <= {k}')} AS recall_{k}" for k in (1, 5, 10, 100))}, {_mrr('emb_rank')} AS emb_mrr, round(avg(emb_ms), 6) AS emb_ms,
  round(quantile_cont(emb_ms, 0.5), 6) AS emb_ms_p50, round(quantile_cont(emb_ms, 0.95), 6) AS emb_ms_p95 FROM results GROUP BY variant_type)
SELECT * FROM u LEFT JOIN w USING (variant_type)"""),
    "rank_histogram": Query(rank_histogram, f"WITH {WITH_RESULTS} " + " UNION ALL ".join(f"SELECT '{m}' AS mode, {_BUCKET.format(f'{m}_rank')} AS bucket, count(*) AS n FROM results GROUP BY ALL" for m in ("name", "emb"))),
    "query_name_types": Query(query_name_types, _R + f"{_KIND} AS kind, {_SCRIPT} AS script, count(*) AS n FROM results GROUP BY ALL"),
    "mode_pairing": Query(mode_pairing, _BY_SCORE + f", a AS ({_SIDE.format('name')}), b AS ({_SIDE.format('emb')}) SELECT e.case_id, expected_entity_id, a.rank AS name_rank, a.total AS name_total, b.rank AS emb_rank, b.total AS emb_total FROM expected e LEFT JOIN a USING (case_id) LEFT JOIN b USING (case_id) WHERE e.case_id IN (SELECT case_id FROM hits)"),
    "response_flatten": Query(response_flatten, f"WITH {WITH_HITS} SELECT case_id, CAST(row_number() OVER (PARTITION BY case_id ORDER BY ordinal) - 1 AS INTEGER) AS ordinal, entity_id, gnr_score, emb_score FROM hits WHERE mode = 'emb' QUALIFY entity_id <> 3"),
    "embedding_contribution": Query(embedding_contribution, f"WITH {WITH_HITS} SELECT case_id, count(*) FILTER (ordinal % 3 <> 0 AND emb_score IS NOT NULL) AS retrieved_and_scored, count(*) FILTER (ordinal % 3 <> 0 AND emb_score IS NULL) AS retrieved_only, count(*) FILTER (ordinal % 3 = 0) AS neither FROM hits GROUP BY 1"),
    "sibling_recall": Query(sibling_recall, _TOP + "SELECT case_id, round(100.0::DOUBLE * count(distance) / count(*), 6) AS sibling_recall FROM f GROUP BY case_id"),
    "sibling_report": Query(sibling_report, _TOP + f", r AS (SELECT case_id, 100.0::DOUBLE * count(distance) / count(*) AS recall FROM f GROUP BY case_id) SELECT count(*) AS cases, round(avg(recall), 6) AS mean_recall, count(*) FILTER (recall = 100) AS perfect, {_pct('recall = 100')} AS perfect_rate FROM r"),
    "intra_distance": Query(intra_distance, _TOP + f"SELECT count(*) AS n, {_stats('distance', 'distance')}, round(quantile_cont(distance, 0.95), 6) AS p95 FROM f WHERE distance IS NOT NULL"),
    "compare_models": Query(compare_models, _REPORTS + "SELECT test_set, model_type, split_part(model_path, '/', 3) AS model, emb_accuracy, ndcg_10, round(max(emb_accuracy) OVER (PARTITION BY test_set, model_type) - emb_accuracy, 6) AS behind FROM g"),
    "best_models": Query(best_models, _REPORTS + "SELECT test_set, model_type, model_path, emb_accuracy FROM g QUALIFY row_number() OVER (PARTITION BY test_set, model_type ORDER BY emb_accuracy DESC, model_path) = 1"),
    "compare_validations": Query(compare_validations, f"WITH {WITH_RESULTS}, g AS (SELECT case_id % 3 AS r, {_retrieval('cases', 'name_recall_1', 'emb_recall_1')} FROM results GROUP BY r) SELECT 'run' || r AS model, 'unknown' AS none, cases, name_recall_1, emb_recall_1, round(emb_recall_1 - name_recall_1, 6) AS gain FROM g"),
    "baseline_delta": Query(baseline_delta, f"""WITH {WITH_RESULTS}, g AS (SELECT case_id % 2 AS half, avg(1.0::DOUBLE / name_rank) AS name_mrr_found, avg(1.0::DOUBLE / emb_rank) AS emb_mrr_found, 100 * avg(CASE WHEN emb_rank <= 1 THEN 1.0::DOUBLE ELSE 0 END) AS emb_recall_1, CAST(case_id % 2 AS DOUBLE) AS zero FROM results GROUP BY half),
l AS ({" UNION ALL ".join(f"SELECT half, '{m}' AS metric, {m} AS v FROM g" for m in _DELTA)}), p AS (SELECT metric, max(v) FILTER (half = 1) AS c, max(v) FILTER (half = 0) AS b FROM l GROUP BY metric)
SELECT metric, round(c, 6) AS current, round(b, 6) AS baseline, round(c - b, 6) AS delta, round(coalesce(100 * (c - b) / nullif(b, 0), 0), 6) AS percent FROM p"""),
}


def _long(name: str, sql: str, part: str = "''", drop: str = "") -> str:
    """A report's query as rows of one section."""
    rest = f"* EXCLUDE ({drop})" if drop else "*"
    return f"SELECT '{name}' AS section, part, metric, value FROM (UNPIVOT (SELECT {part} AS part, CAST(COLUMNS({rest}) AS DOUBLE) FROM ({sql})) ON COLUMNS(* EXCLUDE (part)) INTO NAME metric VALUE value)"


_VOLUME = " UNION ALL ".join(
    _long("volume", _R + f"round(avg({m}_total), 6) AS mean_total, round(CAST(median({m}_total) AS DOUBLE), 6) AS median_total, min({m}_total) AS min_total, max({m}_total) AS max_total, {_corr(f'{m}_total', f'{m}_rank')} AS total_rank_corr FROM results", f"'{m}'")
    for m in ("name", "emb")
)
_SECTIONS = (("retrieval", "retrieval_report"), ("ndcg", "ndcg_at_k"), ("rescue", "rescue"), ("impact_found", "impact_found"), ("impact_rank1", "impact_rank1"))
QUERIES["full_report"] = Query(
    full_report,
    " UNION ALL ".join([
        *(_long(section, QUERIES[query].sql) for section, query in _SECTIONS), _VOLUME,
        _long("relative_ranking", QUERIES["relative_ranking"].sql, "mode", "mode"),
        _long("breakdown", QUERIES["breakdown_grouping_sets"].sql, "dimension || ':' || value", "dimension, value"),
        _long("rank_distribution", re.sub(r"\bAS n\b", "AS cases", QUERIES["rank_histogram"].sql), "mode || ':' || bucket", "mode, bucket"),
    ]),
)

