"""Pair, correlation and triplet queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import pairs as ops
from ..operators import ranking, search, stats
from .base import WITH_ALIASES, WITH_HITS, WITH_PAIRS, Query, aliases, hits, pairs, rounded, table
from .resolution import graded

_SCRIPTS = ("LATIN", "CYRILLIC", "CJK")


def _members(spark, d):
    """A brand's parts as an entity's aliases, in scripts by number."""
    p = table(spark, d, "part")
    script = F.element_at(F.array(*map(F.lit, _SCRIPTS)), (F.col("p_partkey") % 3 + 1).cast("int"))
    return p.select(F.col("p_brand").alias("entity"), F.col("p_partkey").alias("ord"), F.concat("p_name", F.lit(" "), F.col("p_partkey").cast("string")).alias("name"), script.alias("script"))


def within_entity_pairs(spark, d):
    return ops.within_entity(_members(spark, d))


def _numbered(spark, d):
    """Each pair, and each third one again the other way round, in order."""
    p = pairs(spark, d)
    i = F.substring("name_a", 2, 20).cast("bigint") * 100 + F.substring("name_b", 2, 20).cast("bigint") - F.substring("name_a", 2, 20).cast("bigint")
    p = p.withColumn("ord", i)
    again = p.filter("ord % 3 = 0").select(F.col("name_b").alias("name_a"), F.col("name_a").alias("name_b"), "same_entity", "pair_type", (F.col("ord") + 1_000_000_000).alias("ord"))
    return p.select("name_a", "name_b", "same_entity", "pair_type", "ord").unionByName(again)


def pair_dedupe(spark, d):
    return ops.deduplicated(_numbered(spark, d), "ord").drop("ord")


def union_pairs(spark, d):
    both = ops.all_pairs(pairs(spark, d).filter("same_entity").drop("cosine_sim"), pairs(spark, d).filter("not same_entity"))
    return both.groupBy("same_entity").agg(F.count(F.lit(1)).alias("n"), F.count("cosine_sim").alias("with_cosine"))


def cross_entity_pairs(spark, d):
    return rounded(ops.cross_entity(aliases(spark, d), 0.2, decimals=6))


def score_pairs(spark, d):
    """Pairs with both scores; names that share a word differ by five."""
    number = lambda c: F.substring(c, 2, 20).cast("bigint") % 5
    worded = lambda c: F.concat(F.col(c), F.lit(" w"), number(c).cast("string")).alias(c)
    a = aliases(spark, d).select("entity", worded("name"), "v")
    p = pairs(spark, d).select(worded("name_a"), worded("name_b"), *[c for c in ops.PAIR if c not in ("name_a", "name_b")])
    known = a.filter("entity % 3 <> 0").select(F.col("entity").alias("entity_b"))
    return rounded(ops.scored(p, a.select("name", "v"), known)).drop("gnr_bucket", "pair_type")


def corr_pearson(spark, d):
    return rounded(stats.pearson(pairs(spark, d)))


def corr_spearman(spark, d):
    return rounded(stats.spearman(pairs(spark, d)))


def corr_kendall(spark, d):
    return rounded(stats.kendall(pairs(spark, d)))


def roc_auc(spark, d):
    p = pairs(spark, d)
    return rounded(stats.roc_auc(p, "cosine_sim", "same_entity"))


def roc_auc_labels(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "n_chars")
    return rounded(stats.roc_auc(docs.join(table(spark, d, "labels"), "doc_id"), "n_chars", "quality"))


def bucket_stats(spark, d):
    from ..functions.text import bucket

    return rounded(stats.grouped(stats.both_present(pairs(spark, d)).withColumn("bucket", bucket(F.col("gnr_score"))), "bucket"))


def pair_type_stats(spark, d):
    return rounded(stats.grouped(pairs(spark, d), "pair_type"))


def problem_cases(spark, d):
    return stats.problem_cases(pairs(spark, d)).select("name_a", "name_b", "gnr_score", "cosine_sim", "problem")


def problem_report(spark, d):
    found = stats.problem_report(pairs(spark, d), ["name_a", "name_b"])
    first = F.array_join(F.transform("examples", lambda e: F.concat_ws(":", e["name_a"], e["name_b"], e["gnr_score"].cast("string"))), ",")
    return rounded(found.withColumn("examples", first))


def mine_triplets(spark, d):
    return ops.triplets(pairs(spark, d), high=60, low=50, cosine=0.0)


def mine_triplets_null(spark, d):
    return ops.triplets(pairs(spark, d), high=60, low=50, cosine=0.0, null_too=True)


def triplet_margin(spark, d):
    return rounded(ops.margins(mine_triplets(spark, d)))


def hard_positives(spark, d):
    return pairs(spark, d).filter(ops.is_hard_positive()).select("name_a", "name_b", "gnr_score", "cosine_sim")


def hard_positive_triplets(spark, d):
    pool = aliases(spark, d).select("entity", "name")
    return ops.hard_positive_triplets(pairs(spark, d), pool)


def weighted_triplets(spark, d):
    """Hard positives with negatives from a pool that has a name once for each
    day of its number modulo seven."""
    pool = aliases(spark, d).select("entity", "name", F.explode(F.sequence(F.lit(0), (F.col("id") % 7).cast("int"))).alias("day"))
    return ops.hard_positive_triplets(pairs(spark, d), pool, weighted=True)


def alias_triplets(spark, d):
    m = table(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("record_id"), F.when(F.col("conv_id") % 2 == 0, "PERSON").otherwise("ORGANIZATION").alias("record_type"), F.col("turn").alias("idx"), F.concat(F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string")).alias("name"))
    return ops.alias_triplets(m)


def script_pairs(spark, d):
    """Pairs' scripts, here by their entities' numbers."""
    script = lambda c: F.element_at(F.array(*map(F.lit, _SCRIPTS)), (F.col(c) % 3 + 1).cast("int"))
    return ops.script_pairs(pairs(spark, d).select(script("entity_a").alias("script_a"), script("entity_b").alias("script_b")))


def distinct_counts(spark, d):
    return pairs(spark, d).agg(F.count_distinct("name_a").alias("anchors"), F.count_distinct("entity_b").alias("entities"))


def per_query_spearman(spark, d):
    return rounded(stats.per_query_spearman(hits(spark, d).filter("mode = 'emb'")))


def per_query_summary(spark, d):
    return rounded(stats.summarised(stats.per_query_spearman(hits(spark, d).filter("mode = 'emb'"))))


def ranking_agreement(spark, d):
    h = hits(spark, d).filter("mode = 'emb' and gnr_score is not null")
    return rounded(stats.ranking_agreement(h))


def best_alias_match(spark, d):
    h = hits(spark, d).select("case_id", (F.col("entity_id") % 4).alias("entity_id"), F.col("ordinal").alias("nth"), F.concat(F.col("mode"), F.lit("-"), F.col("ordinal").cast("string")).alias("name"), "cosine").filter("name like 'emb%'")
    return stats.best_alias(h, 6)


def topk_overlap(spark, d):
    """Which names two searches both have among their ten best: one over the
    vectors' first half, one over whole vectors."""
    whole = aliases(spark, d)
    half = whole.withColumn("v", F.slice("v", 1, 32))
    named = lambda f: f.select("query_id", "rank", F.concat(F.lit("n"), F.col("feat_id").cast("string")).alias("name"))
    found, other = (named(search.neighbours(a.filter("id % 20 = 0"), a, k=10, decimals=6)) for a in (half, whole))
    return rounded(ranking.name_overlap(found, other, 10))


# SQL.
_P = f"WITH {WITH_PAIRS} "
_BOTH = f"WITH {WITH_PAIRS}, p AS (SELECT *, CAST(gnr_score AS DOUBLE) AS g, cosine_sim AS c FROM pairs WHERE gnr_score IS NOT NULL AND cosine_sim IS NOT NULL) "


def _corr(x: str, y: str) -> str:
    return f"round(coalesce(covar_pop({x}, {y}) / nullif(stddev_pop({x}) * stddev_pop({y}), 0), 0), 6)"


def _raw_corr(x: str, y: str) -> str:
    return f"coalesce(covar_pop({x}, {y}) / nullif(stddev_pop({x}) * stddev_pop({y}), 0), 0)"


def _rank(v: str, by: str = "") -> str:
    return f"rank() OVER ({by} ORDER BY {v}) + (count(*) OVER (PARTITION BY {by.replace('PARTITION BY ', '') + ', ' if by else ''}{v}) - 1) / 2.0::DOUBLE"


def _auc(rows: str) -> str:
    return f"r AS (SELECT y, {_rank('s')} AS r FROM ({rows})), s AS (SELECT sum(r) FILTER (y) AS r, count(*) FILTER (y) AS p, count(*) FILTER (NOT y) AS q FROM r) SELECT round(coalesce((r - p * (p + 1) / 2.0::DOUBLE) / nullif(p * q, 0), 0.5), 6) AS auc, p AS positives, q AS negatives FROM s"


_STATS = "count(*) AS n, round(avg(cosine_sim), 6) AS cos_mean, round(median(cosine_sim), 6) AS cos_median, min(cosine_sim) AS cos_min, max(cosine_sim) AS cos_max, round(stddev_pop(cosine_sim), 6) AS cos_std"
_MEMBERS = "m AS (SELECT p_brand AS entity, p_partkey AS ord, p_name || ' ' || p_partkey AS name, ['LATIN', 'CYRILLIC', 'CJK'][1 + p_partkey % 3] AS script FROM part)"


def _triplets(null_too: bool) -> str:
    g = "coalesce(gnr_score, CASE WHEN same_entity THEN 100 ELSE 0 END)"
    ok = (lambda c: f"coalesce({c}, {str(null_too).lower()})")
    return f"""WITH {WITH_PAIRS}, b AS (SELECT name_a, name_b, entity_a, same_entity, gnr_score, cosine_sim FROM pairs UNION ALL SELECT name_b, name_a, entity_b, same_entity, gnr_score, cosine_sim FROM pairs),
p AS (SELECT name_a AS anchor, name_b AS positive, entity_a AS anchor_group, cosine_sim AS positive_cosine, row_number() OVER (PARTITION BY name_a ORDER BY {g} DESC, name_b) AS i FROM b WHERE same_entity AND {ok("gnr_score >= 60")}),
n AS (SELECT name_a AS anchor, name_b AS negative, cosine_sim AS negative_cosine, row_number() OVER (PARTITION BY name_a ORDER BY cosine_sim DESC, name_b) AS j FROM b WHERE NOT same_entity AND {ok("gnr_score < 50")} AND cosine_sim >= 0.0),
t AS (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY i, j) AS k FROM p JOIN n USING (anchor) QUALIFY k <= 5) """


_TRIPLET = "anchor, positive, negative, anchor_group, positive_cosine, negative_cosine"
_HALF = "list_dot_product(q.v[1:32], t.v[1:32])"
_KNN10 = "row_number() OVER (PARTITION BY q.id ORDER BY round({0}, 6) DESC, t.id) AS rank FROM aliases q JOIN aliases t ON q.id <> t.id WHERE q.id % 20 = 0"


def _tail(area: str, of: str) -> str:
    """Two-sided p-value of a score ``t`` in ``of``: Simpson's rule over the
    density up to it."""
    return f"""1 - 2 * (SELECT sum((CASE WHEN k = 0 OR k = 20000 THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END) * {area}) * any_value(t) / 60000 FROM {of}, (SELECT unnest(range(0, 20001)) AS k))"""


def _student(name: str) -> str:
    """A correlation ``r`` of ``n`` rows in ``c`` with its p-value."""
    density = "exp(lgamma((v + 1) / 2) - lgamma(v / 2)) / sqrt(v * pi()) * pow(1 + pow(t * k / 20000, 2) / v, -(v + 1) / 2)"
    return f", s AS (SELECT r, n, CAST(n - 2 AS DOUBLE) AS v, abs(r) * sqrt((n - 2) / (1 - r * r)) AS t FROM c) SELECT round(r, 6) AS {name}, n, round({_tail(density, 's')}, 6) AS p_value FROM s"


def _others(pairs: str, keys: str, pool: str, n: int, by: str = "") -> str:
    """``z``: rows of ``pairs`` (``entity``), each with ``n`` negatives from
    ``pool`` (``entity, name``), drawn as the operator draws them."""
    within, on = (f"PARTITION BY {by}", f"AND p.{by} = e.{by}") if by else ("", "")
    cols = f"{by}, " if by else ""
    return f"""o AS (SELECT DISTINCT {cols}entity, name FROM ({pool})), num AS (SELECT *, row_number() OVER ({within} ORDER BY md5(CAST(entity AS VARCHAR)), entity, md5(name), name) - 1 AS place, count(*) OVER ({within}) AS total FROM o),
e AS (SELECT {cols}entity, min(place) AS first, count(*) AS own FROM num GROUP BY ALL), t AS (SELECT DISTINCT {cols}total FROM num),
d AS (SELECT p.*, e.first, coalesce(e.own, 0) AS own, t.total - coalesce(e.own, 0) AS others FROM ({pairs}) p JOIN t ON {f"p.{by} = t.{by}" if by else "true"} LEFT JOIN e ON p.entity = e.entity {on}),
x AS (SELECT *, unnest(range(0, least({n}, others))) AS j FROM d), y AS (SELECT *, (CAST('0x' || substr(md5('42|' || {keys}), 1, 12) AS BIGINT) + j * greatest(1, others // {n})) % others AS spot FROM x),
z AS (SELECT y.*, num.name AS negative FROM y JOIN num ON {f"y.{by} = num.{by} AND" if by else ""} num.place = CASE WHEN first IS NOT NULL AND spot >= first THEN spot + own ELSE spot END) """


_Q = f"""WITH {WITH_HITS}, h AS (SELECT * FROM hits WHERE mode = 'emb' AND gnr_score IS NOT NULL), r AS (SELECT case_id, {_rank('gnr_score', 'PARTITION BY case_id')} AS rg, {_rank('cosine', 'PARTITION BY case_id')} AS rc FROM h),
q AS (SELECT case_id, round(covar_pop(rg, rc) / nullif(stddev_pop(rg) * stddev_pop(rc), 0), 9) AS spearman FROM r GROUP BY case_id HAVING count(*) >= 2 AND stddev_pop(rg) * stddev_pop(rc) <> 0) """

QUERIES = {
    "within_entity_pairs": Query(within_entity_pairs, f"""WITH {_MEMBERS}, p AS (SELECT a.name AS name_a, b.name AS name_b, a.entity AS entity, a.script <> b.script AS x, row_number() OVER (PARTITION BY a.entity ORDER BY a.script <> b.script DESC, a.ord, b.ord) AS n FROM m a JOIN m b ON a.entity = b.entity AND a.ord < b.ord)
SELECT name_a, name_b, entity AS entity_a, entity AS entity_b, true AS same_entity, CASE WHEN x THEN 'within_entity_cross_script' ELSE 'within_entity_same_script' END AS pair_type FROM p WHERE n <= 6"""),
    "pair_dedupe": Query(pair_dedupe, f"""WITH {WITH_PAIRS}, p AS (SELECT name_a, name_b, same_entity, pair_type, CAST(substr(name_a, 2) AS BIGINT) * 100 + CAST(substr(name_b, 2) AS BIGINT) - CAST(substr(name_a, 2) AS BIGINT) AS ord FROM pairs),
u AS (SELECT * FROM p UNION ALL SELECT name_b, name_a, same_entity, pair_type, ord + 1000000000 FROM p WHERE ord % 3 = 0)
SELECT name_a, name_b, same_entity, pair_type FROM u QUALIFY row_number() OVER (PARTITION BY least(name_a, name_b), greatest(name_a, name_b), same_entity ORDER BY ord) = 1"""),
    "union_pairs": Query(union_pairs, _P + "SELECT same_entity, count(*) AS n, count(*) FILTER (NOT same_entity) AS with_cosine FROM pairs GROUP BY 1"),
    "cross_entity_pairs": Query(cross_entity_pairs, f"""WITH {WITH_ALIASES}, f AS (SELECT id FROM aliases QUALIFY row_number() OVER (PARTITION BY entity ORDER BY id) <= 3),
c AS (SELECT q.name AS name_a, t.name AS name_b, q.entity AS entity_a, t.entity AS entity_b, round(list_dot_product(q.v, t.v), 6) AS initial_cosine, q.id AS a, t.id AS b FROM aliases q JOIN aliases t ON q.entity <> t.entity WHERE q.id IN (FROM f))
SELECT name_a, name_b, entity_a, entity_b, false AS same_entity, 'cross_entity_embedding_match' AS pair_type, initial_cosine FROM c WHERE initial_cosine >= 0.2 QUALIFY row_number() OVER (PARTITION BY a ORDER BY initial_cosine DESC, b) <= 5"""),
    "score_pairs": Query(score_pairs, f"""WITH RECURSIVE {WITH_PAIRS}, p AS (SELECT name_a || ' w' || CAST(substr(name_a, 2) AS BIGINT) % 5 AS name_a, name_b || ' w' || CAST(substr(name_b, 2) AS BIGINT) % 5 AS name_b, entity_a, entity_b, same_entity, cosine_sim FROM pairs),
q AS (SELECT name_a AS x, name_b AS y FROM p), {graded("q")} SELECT name_a, name_b, entity_a, entity_b, same_entity, CASE WHEN entity_b % 3 <> 0 THEN score END AS gnr_score, cosine_sim FROM p LEFT JOIN graded ON x = name_a AND y = name_b"""),
    "corr_pearson": Query(corr_pearson, _BOTH + f", c AS (SELECT {_raw_corr('g', 'c')} AS r, count(*) AS n FROM p)" + _student("pearson")),
    "corr_spearman": Query(corr_spearman, _BOTH + f", k AS (SELECT {_rank('g')} AS rg, {_rank('c')} AS rc FROM p), c AS (SELECT {_raw_corr('rg', 'rc')} AS r, count(*) AS n FROM k)" + _student("spearman")),
    "corr_kendall": Query(corr_kendall, _BOTH + """, k AS (SELECT row_number() OVER () AS i, g, c FROM p), q AS (SELECT sum(sign(a.g - b.g) * sign(a.c - b.c)) AS s FROM k a JOIN k b ON a.i < b.i), m AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM k),
x AS (SELECT sum(t * (t - 1) / 2) AS t, sum(t * (t - 1) * (t - 2)) AS a, sum(t * (t - 1) * (2 * t + 5)) AS b FROM (SELECT CAST(count(*) AS DOUBLE) AS t FROM k GROUP BY g)),
y AS (SELECT sum(t * (t - 1) / 2) AS t, sum(t * (t - 1) * (t - 2)) AS a, sum(t * (t - 1) * (2 * t + 5)) AS b FROM (SELECT CAST(count(*) AS DOUBLE) AS t FROM k GROUP BY c)),
z AS (SELECT s / sqrt((n * (n - 1) / 2 - x.t) * (n * (n - 1) / 2 - y.t)) AS kendall, abs(s / sqrt((n * (n - 1) * (2 * n + 5) - x.b - y.b) / 18 + 2 * x.t * y.t / (n * (n - 1)) + x.a * y.a / (9 * n * (n - 1) * (n - 2)))) AS t FROM q, m, x, y) """
      + f"SELECT round(kendall, 6) AS kendall, round({_tail('exp(-pow(t * k / 20000, 2) / 2) / sqrt(2 * pi())', 'z')}, 6) AS p_value FROM z"),
    "roc_auc": Query(roc_auc, f"WITH {WITH_PAIRS}, " + _auc("SELECT cosine_sim AS s, same_entity AS y FROM pairs")),
    "roc_auc_labels": Query(roc_auc_labels, "WITH " + _auc("SELECT CAST(n_chars AS DOUBLE) AS s, quality = 1 AS y FROM documents JOIN labels USING (doc_id) WHERE n_chars IS NOT NULL AND quality IS NOT NULL")),
    "bucket_stats": Query(bucket_stats, _BOTH + f"SELECT CASE WHEN g >= 80 THEN 'same' WHEN g >= 50 THEN 'close' WHEN g >= 30 THEN 'likely' WHEN g >= 20 THEN 'plausible' WHEN g >= 10 THEN 'unlikely' END AS bucket, {_STATS} FROM p GROUP BY 1"),
    "pair_type_stats": Query(pair_type_stats, _P + f"SELECT pair_type, {_STATS} FROM pairs GROUP BY 1"),
    "problem_cases": Query(problem_cases, _P + "SELECT name_a, name_b, gnr_score, cosine_sim, CASE WHEN cosine_sim >= 0.70 AND gnr_score < 50 THEN 'high_cosine_low_name' ELSE 'low_cosine_high_name' END AS problem FROM pairs WHERE (cosine_sim >= 0.70 AND gnr_score < 50) OR (cosine_sim < 0.50 AND gnr_score >= 85)"),
    "mine_triplets": Query(mine_triplets, _triplets(False) + f"SELECT {_TRIPLET} FROM t"),
    "mine_triplets_null": Query(mine_triplets_null, _triplets(True) + f"SELECT {_TRIPLET} FROM t"),
    "triplet_margin": Query(triplet_margin, _triplets(False) + ", g AS (SELECT *, positive_cosine - negative_cosine AS m FROM t) SELECT count(*) AS triplets, count(DISTINCT anchor) AS anchors, count(DISTINCT positive) AS positives, count(DISTINCT negative) AS negatives, round(min(m), 6) AS min_margin, round(max(m), 6) AS max_margin, round(avg(m), 6) AS mean_margin, count(*) FILTER (m < 0) AS negative_margins, round(100.0::DOUBLE * count(*) FILTER (m < 0) / count(*), 6) AS negative_percent FROM g"),
    "hard_positives": Query(hard_positives, _P + "SELECT name_a, name_b, gnr_score, cosine_sim FROM pairs WHERE same_entity AND cosine_sim < 0.6 AND coalesce(gnr_score >= 85, true)"),
    "problem_report": Query(problem_report, _P + """, b AS (SELECT *, CASE WHEN cosine_sim >= 0.70 AND gnr_score < 50 THEN 'high_cosine_low_name' WHEN cosine_sim < 0.50 AND gnr_score >= 85 THEN 'low_cosine_high_name' END AS problem FROM pairs WHERE gnr_score IS NOT NULL AND cosine_sim IS NOT NULL),
f AS (SELECT *, row_number() OVER (PARTITION BY problem ORDER BY name_a, name_b) AS k FROM b WHERE problem IS NOT NULL)
SELECT v.problem, count(f.name_a) AS n, round(100.0::DOUBLE * count(f.name_a) / (SELECT count(*) FROM b), 6) AS percent, coalesce(string_agg(name_a || ':' || name_b || ':' || gnr_score, ',' ORDER BY name_a, name_b) FILTER (k <= 10), '') AS examples
FROM (VALUES ('high_cosine_low_name'), ('low_cosine_high_name')) v(problem) LEFT JOIN f USING (problem) GROUP BY v.problem"""),
    "hard_positive_triplets": Query(hard_positive_triplets, f"WITH {WITH_PAIRS}, {WITH_ALIASES}, " + _others("SELECT name_a, name_b, entity_a AS entity FROM pairs WHERE same_entity AND cosine_sim < 0.6 AND coalesce(gnr_score >= 85, true)", "name_a || '|' || name_b", "SELECT entity, name FROM aliases", 3)
      + "SELECT name_a AS anchor, name_b AS positive, negative, entity AS anchor_group FROM z UNION ALL SELECT name_b, name_a, negative, entity FROM z"),
    "weighted_triplets": Query(weighted_triplets, f"""WITH {WITH_PAIRS}, {WITH_ALIASES}, o AS (SELECT entity, name, 1 + id % 7 AS w FROM aliases),
num AS (SELECT *, sum(w) OVER (ORDER BY md5(CAST(entity AS VARCHAR)), entity, md5(name), name) - w AS place, sum(w) OVER () AS total FROM o), e AS (SELECT entity, min(place) AS first, sum(w) AS own FROM num GROUP BY entity),
p AS (SELECT name_a, name_b, entity_a AS entity, unnest([0, 1, 2]) AS j FROM pairs WHERE same_entity AND cosine_sim < 0.6 AND coalesce(gnr_score >= 85, true)),
d AS (SELECT p.*, e.first, e.own, CAST('0x' || substr(md5('42|' || name_a || '|' || name_b || '|' || j), 1, 12) AS BIGINT) % ((SELECT max(total) FROM num) - e.own) AS spot FROM p JOIN e USING (entity)),
z AS (SELECT d.*, num.name AS negative FROM d JOIN num ON CASE WHEN spot >= first THEN spot + own ELSE spot END >= num.place AND CASE WHEN spot >= first THEN spot + own ELSE spot END < num.place + num.w)
SELECT name_a AS anchor, name_b AS positive, negative, entity AS anchor_group FROM z UNION ALL SELECT name_b, name_a, negative, entity FROM z"""),
    "alias_triplets": Query(alias_triplets, """WITH n AS (SELECT CAST(conv_id AS VARCHAR) AS record_id, CASE WHEN conv_id % 2 = 0 THEN 'PERSON' ELSE 'ORGANIZATION' END AS record_type, turn AS idx, conv_id || ':' || turn AS name FROM conversations),
q AS (SELECT a.record_id AS entity, a.record_type, a.idx AS i, b.idx AS other, a.name AS anchor, b.name AS positive FROM n a JOIN n b ON a.record_id = b.record_id AND a.idx < b.idx AND a.name <> b.name QUALIFY row_number() OVER (PARTITION BY a.record_id ORDER BY a.idx, b.idx) <= 5), """
      + _others("SELECT * FROM q", "entity || '|' || i || '|' || other", "SELECT record_type, record_id AS entity, name FROM n WHERE idx = 0", 1, "record_type") + "SELECT anchor, positive, negative, record_type, entity AS record_id FROM z"),
    "script_pairs": Query(script_pairs, _P + ", s AS (SELECT ['LATIN', 'CYRILLIC', 'CJK'][1 + entity_a % 3] AS a, ['LATIN', 'CYRILLIC', 'CJK'][1 + entity_b % 3] AS b FROM pairs) SELECT least(a, b) AS script_x, greatest(a, b) AS script_y, count(*) AS n FROM s GROUP BY ALL"),
    "distinct_counts": Query(distinct_counts, _P + "SELECT count(DISTINCT name_a) AS anchors, count(DISTINCT entity_b) AS entities FROM pairs"),
    "per_query_spearman": Query(per_query_spearman, _Q + "SELECT case_id, round(spearman, 6) AS spearman FROM q"),
    "per_query_summary": Query(per_query_summary, _Q + "SELECT count(*) AS queries, round(avg(spearman), 6) AS mean, round(median(spearman), 6) AS median, round(stddev_pop(spearman), 6) AS std, round(avg(CASE WHEN spearman > 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS positive_rate FROM q"),
    "ranking_agreement": Query(ranking_agreement, f"""WITH {WITH_HITS}, h AS (SELECT * FROM hits WHERE mode = 'emb' AND gnr_score IS NOT NULL), p AS (SELECT sign(a.gnr_score - b.gnr_score) AS x, sign(a.cosine - b.cosine) AS y FROM h a JOIN h b ON a.case_id = b.case_id AND a.ordinal < b.ordinal),
s AS (SELECT count(*) AS pairs, count(*) FILTER (x = 0 AND y = 0) AS ties, count(*) FILTER (x = y AND x <> 0) AS agreements FROM p) SELECT pairs, ties, agreements, round(CAST(agreements AS DOUBLE) / (pairs - ties), 6) AS rate FROM s"""),
    "best_alias_match": Query(best_alias_match, f"WITH {WITH_HITS} SELECT case_id, entity_id % 4 AS entity_id, cosine, 'emb-' || ordinal AS name FROM hits WHERE mode = 'emb' AND ordinal < 6 QUALIFY row_number() OVER (PARTITION BY case_id, entity_id % 4 ORDER BY cosine DESC, ordinal) = 1"),
    "topk_overlap": Query(topk_overlap, f"""WITH {WITH_ALIASES}, x AS (SELECT q.id AS query_id, t.name AS name, {_KNN10.format(_HALF)} QUALIFY rank <= 10), y AS (SELECT q.id AS query_id, t.name AS name, {_KNN10.format("list_dot_product(q.v, t.v)")} QUALIFY rank <= 10),
a AS (SELECT query_id, list(name) AS x FROM x GROUP BY 1), b AS (SELECT query_id, list(name) AS y FROM y GROUP BY 1)
SELECT query_id, len(list_intersect(x, y)) AS common, round(100.0::DOUBLE * len(list_intersect(x, y)) / 10, 6) AS percent, array_to_string(list_sort(list_intersect(x, y)), ',') AS names FROM a JOIN b USING (query_id)"""),
}
