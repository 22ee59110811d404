"""Vector search queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors
from ..operators import comparison, index, lexical, metrics, search
from ..session import scratch
from .base import WITH_ALIASES, WITH_NAMES, Query, aliases, names, rounded, table
from .resolution import graded

K, D = 10, 6
_COS = f"round(list_dot_product(q.v, t.v), {D})"


def _queries(spark, d, every=5):
    return aliases(spark, d).filter(F.col("id") % every == 0)


def knn_topk(spark, d):
    return search.neighbours(_queries(spark, d), aliases(spark, d), k=K, decimals=D)


def knn_recall(spark, d):
    """Retrieval of each embedding's own label among its nearest others."""
    a = aliases(spark, d)
    found = search.neighbours(a, a, k=100, decimals=D)
    of = lambda c, e: a.select(F.col("id").alias(c), F.col("entity").alias(e))
    hit = found.join(of("query_id", "q"), "query_id").join(of("feat_id", "t"), "feat_id")
    ranks = hit.groupBy("query_id").agg(F.min(F.when(F.col("q") == F.col("t"), F.col("rank"))).alias("rank"))
    out = [F.count(F.lit(1)).alias("cases"), *[metrics.recall_at("rank", k).alias(f"recall_{k}") for k in metrics.KS]]
    return rounded(ranks.agg(*out, metrics.mrr_found("rank").alias("mrr_found"), metrics.mrr_all("rank").alias("mrr_all"), metrics.ndcg_at("rank", 10).alias("ndcg_10")))


def sim_range(spark, d):
    found = search.within(_queries(spark, d), aliases(spark, d), 0.30)
    return found.select("query_id", "feat_id", F.round("cosine", D).alias("cosine"), F.round("distance", D).alias("distance"))


def candidate_043(spark, d):
    return search.neighbours(_queries(spark, d), aliases(spark, d), k=100, least=0.43, decimals=D)


def sim_join_cross_entity(spark, d):
    return search.similarity_join(aliases(spark, d), theta=0.2, decimals=D)


def sim_join_cells(spark, d):
    """The same join in cells, whatever its size."""
    a = aliases(spark, d)
    return search.in_cells(search.query_aliases(a), a, 5, 0.2, True, D, cells=16)


def _clustered(spark, d):
    """Embeddings with their label's own axis beside them."""
    axes = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.when(i == F.col("entity") % 32, 3.0).otherwise(0.0))
    return aliases(spark, d).withColumn("v", F.transform(F.concat(vectors.doubles(F.col("v")), axes), lambda x: x / 10.0**0.5))


def stored_index(spark, d):
    """Search in a stored index, held against exact search: how many neighbours
    there are, whether nine tenths were found, whether a quarter of the rows were
    looked at by their bytes at most, and eight times as many as asked for by their
    vectors."""
    a, path = _clustered(spark, d), scratch(spark)
    index.build(a, path, cells=32)
    q = a.filter("id % 5 = 0")
    found, told = index.searched(q, path, K, probes=5, again=8)
    r = search.recall(found, search.neighbours(q, a, k=K))
    return r.crossJoin(F.broadcast(told)).select("exact", (F.col("recall") >= 0.9).alias("enough"), (4 * F.col("codes") <= F.col("rows")).alias("quarter"), (F.col("vectors") <= 8 * K * F.col("queries")).alias("few"), "queries", "rows")


def clustered_join(spark, d):
    """All pairs above a cosine, of embeddings with their label's own axis beside
    them, and whether cells spared half of the products."""
    a = _clustered(spark, d)
    cells = search.Cells(a, 32)
    half = search.shares(a, cells, 0.92).select((2 * F.col("rows_met") < F.col("rows")).alias("spared"))
    found = search.in_cells(None, cells, least=0.92, decimals=D).select("query_id", "rank", "feat_id", "cosine")
    return found.crossJoin(F.broadcast(half))


def l2_normalize(spark, d):
    v = vectors.l2_normalize(F.transform(vectors.doubles(F.col("embedding")), lambda x: x * 3.0))
    return table(spark, d, "embeddings").select("vec_id", F.transform(v, lambda x: vectors.rounded(x, D)).alias("v"), F.round(vectors.norm(v), D).alias("norm"))


def matryoshka(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.transform(vectors.matryoshka(F.col("embedding"), 16), lambda x: vectors.rounded(x, D)).alias("v"))


def vector_roundtrip(spark, d):
    back = vectors.from_text(vectors.to_text(F.col("embedding")))
    return table(spark, d, "embeddings").select("vec_id", (back == F.col("embedding")).alias("equal"), F.size(back).cast("long").alias("n"))


def conversion_check(spark, d):
    """Embeddings against copies with coarser components, by kind of model: to
    four places, by 16-bit floats and in bytes calibrated by dimension."""
    e = aliases(spark, d).select("id", "v")
    step = lambda n: F.transform("v", lambda x: F.round(x * n) / n)
    scales = vectors.int8_scales(e, "v", "id")
    copies = {"fp32": step(10_000), "fp16": vectors.half_precision(F.col("v")), "int8": vectors.from_int8(vectors.to_int8(F.col("v"), scales), scales)}
    out = None
    for kind, v in copies.items():
        one = comparison.conversion_check(e, e.withColumn("v", v), kind).withColumn("kind", F.lit(kind))
        out = one if out is None else out.unionByName(one)
    return rounded(out)


def int8_products(spark, d):
    """Inner products of each embedding and the seven after it in whole numbers
    of calibrated steps."""
    e = aliases(spark, d).select("id", "v")
    packed = e.select("id", vectors.to_int8(F.col("v"), vectors.int8_scales(e, "v", "id")).alias("p"))
    after = packed.select(F.col("id").alias("a"), F.col("p").alias("pa"), F.explode(F.sequence(F.col("id") + 1, F.col("id") + 7)).alias("b"))
    both = after.join(packed.select(F.col("id").alias("b"), F.col("p").alias("pb")), "b")
    return both.select("a", "b", vectors.int8_dot("pa", "pb").alias("product"), F.octet_length("pa").cast("long").alias("bytes"))


def similar_names(spark, d):
    """Fixed names and every tenth document's against all names."""
    n = names(spark, d).select("id", "name")
    found = lexical.similar_names(n.filter("id like 'n%' or id like '%0'"), n, 0.4).filter("query_id <> id")
    return rounded(found)


def entity_hits(spark, d):
    """Labels as entities that embeddings with short names reach both ways."""
    a = aliases(spark, d).withColumn("name", F.concat(F.lit("w"), (F.col("id") % 97).cast("string"), F.lit(" w"), (F.col("id") % 89).cast("string")))
    return lexical.entity_hits(a.filter("id % 25 = 0"), a, 0.3, 0.35).select("case_id", "entity_id", "gnr_score", "emb_score")


def knn_approximate(spark, d):
    """Search by cells at its defaults against exact search: recall of nine tenths
    or more."""
    q, a = _queries(spark, d), aliases(spark, d)
    r = search.recall(search.approximate(q, a, K), search.neighbours(q, a, k=K))
    return r.select("exact", (F.col("recall") >= 0.9).alias("enough"))


def encode_names(spark, d):
    """Names through the stand-in encoder: how many, and whether all are units."""
    e = vectors.encode_names(names(spark, d).filter("name <> ''"), "name", vectors.hash_encoder(64))
    n = vectors.norm(F.col("embedding"))
    return e.agg(F.count(F.lit(1)).alias("names"), F.count_distinct("name").alias("distinct_names"), F.round(F.min(n), 4).alias("least"), F.round(F.max(n), 4).alias("largest"), F.max(F.size("embedding")).cast("long").alias("dim"))


def fp16_error(spark, d):
    """Vectors rounded to 16 bits: their sums, and the largest error of each."""
    e = table(spark, d, "embeddings").select("vec_id", "embedding", vectors.half_precision(F.col("embedding")).alias("h"))
    gap = F.array_max(F.zip_with("embedding", "h", lambda x, y: F.abs(x.cast("double") - y.cast("double"))))
    return rounded(e.select("vec_id", F.aggregate(vectors.doubles(F.col("h")), F.lit(0.0), lambda a, x: a + x).alias("total"), gap.alias("error")), 9)


# The nearest number of eleven significant bits, halves to even; below 2 ** -14
# in steps of 2 ** -24.
_HALF = "list_transform(CAST(embedding AS DOUBLE[]), lambda x: CASE WHEN x = 0 THEN 0 ELSE round_even(x / pow(2, greatest(floor(log2(abs(x))), -14) - 10), 0) * pow(2, greatest(floor(log2(abs(x))), -14) - 10) END)"
#: The table is smaller than the calibration sample, which has all of it.
_STEPS = """x AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings), m AS (SELECT i, max(abs(v[i])) AS m FROM x GROUP BY i),
steps AS (SELECT list(CASE WHEN m = 0 THEN 1 ELSE m / 127 END ORDER BY i) AS steps FROM m),
bytes AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, list_transform(range(1, len(embedding) + 1), lambda i: greatest(-127, least(127, round(CAST(embedding[i] AS DOUBLE) / steps[i])))) AS q FROM embeddings, steps)"""
_KNN = f"""
WITH {WITH_ALIASES}, c AS (SELECT q.id AS query_id, t.id AS feat_id, q.entity AS qe, t.entity AS te, {_COS} AS cosine FROM aliases q JOIN aliases t ON q.id <> t.id WHERE {{where}}),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, feat_id) AS INTEGER) AS rank FROM c)
"""


def _knn(where: str, k: int) -> str:
    return _KNN.format(where=where) + f"SELECT query_id, rank, feat_id, cosine FROM r WHERE rank <= {k}"


_V = f"list_transform({{}}, lambda x: round(x / sqrt(list_dot_product({{}}, {{}})), {D}))"
_TRIPLE = "list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * 3.0::DOUBLE)"
_HEAD = "CAST(embedding[1:16] AS DOUBLE[])"

QUERIES = {
    "knn_topk": Query(knn_topk, _knn("q.id % 5 = 0", K)),
    "knn_recall": Query(knn_recall, _KNN.format(where="true") + f""",
m AS (SELECT query_id, min(CASE WHEN qe = te THEN rank END) AS rank FROM r WHERE rank <= 100 GROUP BY query_id)
SELECT count(*) AS cases, {", ".join(f"round(100 * avg(CASE WHEN rank <= {k} THEN 1.0::DOUBLE ELSE 0 END), 6) AS recall_{k}" for k in metrics.KS)},
  round(avg(1.0::DOUBLE / rank), 6) AS mrr_found, round(avg(coalesce(1.0::DOUBLE / rank, 0)), 6) AS mrr_all, round(avg(CASE WHEN rank <= 10 THEN 1.0::DOUBLE / log2(rank + 1) ELSE 0 END), 6) AS ndcg_10 FROM m"""),
    "sim_range": Query(sim_range, f"WITH {WITH_ALIASES} SELECT q.id AS query_id, t.id AS feat_id, {_COS} AS cosine, round(1 - list_dot_product(q.v, t.v), {D}) AS distance FROM aliases q JOIN aliases t ON q.id <> t.id WHERE q.id % 5 = 0 AND list_dot_product(q.v, t.v) >= 0.30"),
    "candidate_043": Query(candidate_043, _knn(f"q.id % 5 = 0 AND {_COS} >= 0.43", 100)),
    "sim_join_cross_entity": Query(sim_join_cross_entity, _knn(f"q.entity <> t.entity AND {_COS} >= 0.2 AND q.id IN (SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY entity ORDER BY id) AS n FROM aliases) WHERE n <= 3)", 5)),
    "sim_join_cells": Query(sim_join_cells, _knn(f"q.entity <> t.entity AND {_COS} >= 0.2 AND q.id IN (SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY entity ORDER BY id) AS n FROM aliases) WHERE n <= 3)", 5)),
    "clustered_join": Query(clustered_join, f"WITH {WITH_ALIASES}, c AS (SELECT q.id AS query_id, t.id AS feat_id, round((list_dot_product(q.v, t.v) + CASE WHEN q.entity % 32 = t.entity % 32 THEN 9 ELSE 0 END) / 10, {D}) AS cosine FROM aliases q JOIN aliases t ON q.id <> t.id) SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, feat_id) AS INTEGER) AS rank, feat_id, cosine, true AS spared FROM c WHERE cosine >= 0.92"),
    "l2_normalize": Query(l2_normalize, f"SELECT vec_id, {_V.format(_TRIPLE, _TRIPLE, _TRIPLE)} AS v, 1.0::DOUBLE AS norm FROM embeddings"),
    "matryoshka": Query(matryoshka, f"SELECT vec_id, {_V.format(_HEAD, _HEAD, _HEAD)} AS v FROM embeddings"),
    "vector_roundtrip": Query(vector_roundtrip, "SELECT vec_id, CAST(CAST(embedding AS VARCHAR) AS FLOAT[]) = embedding AS equal, len(embedding) AS n FROM embeddings"),
    "knn_approximate": Query(knn_approximate, f"SELECT {K} * count(*) AS exact, true AS enough FROM embeddings WHERE vec_id % 5 = 0"),
    "stored_index": Query(stored_index, f"SELECT {K} * count(*) AS exact, true AS enough, true AS quarter, true AS few, count(*) AS queries, count(*) * (SELECT count(*) FROM embeddings) AS rows FROM embeddings WHERE vec_id % 5 = 0"),
    "similar_names": Query(similar_names, rf"""WITH {WITH_NAMES}, w AS (SELECT id, list_distinct(list_filter(string_split_regex(lower(name), '\s+'), lambda x: x <> '')) AS w FROM names),
c AS (SELECT q.id AS query_id, t.id, len(list_intersect(q.w, t.w)) / len(list_distinct(list_concat(q.w, t.w)))::DOUBLE AS jaccard FROM w q JOIN w t ON q.id <> t.id AND len(q.w) > 0 AND len(t.w) > 0 WHERE q.id LIKE 'n%' OR q.id LIKE '%0')
SELECT query_id, id, round(jaccard, 6) AS jaccard FROM c WHERE jaccard >= 0.4"""),
    "entity_hits": Query(entity_hits, f"""WITH RECURSIVE {WITH_ALIASES}, c AS (SELECT q.id AS case_id, t.entity AS entity_id, q.id <> t.id AS other, list_dot_product(q.v, t.v) AS cosine, t.id AS tid,
  [q.id % 97, q.id % 89] AS a, [t.id % 97, t.id % 89] AS b, 'w' || q.id % 97 || ' w' || q.id % 89 AS x, 'w' || t.id % 97 || ' w' || t.id % 89 AS y FROM aliases q JOIN aliases t ON q.id % 25 = 0),
j AS (SELECT *, len(list_intersect(list_distinct(a), list_distinct(b))) / len(list_distinct(list_concat(a, b)))::DOUBLE AS jaccard FROM c), k AS (SELECT x, y FROM j WHERE jaccard >= 0.3), {graded("k")},
f AS (SELECT case_id, entity_id, CASE WHEN jaccard >= 0.3 THEN score END AS g, CASE WHEN other AND cosine >= 0.35 THEN CAST(floor(100 * cosine + 1e-6) AS INTEGER) END AS e FROM j LEFT JOIN graded USING (x, y) WHERE jaccard >= 0.3 OR (other AND cosine >= 0.35))
SELECT case_id, entity_id, max(g) AS gnr_score, max(e) AS emb_score FROM f GROUP BY 1, 2"""),
    "encode_names": Query(encode_names, f"WITH {WITH_NAMES} SELECT count(*) AS names, count(DISTINCT name) AS distinct_names, 1.0::DOUBLE AS least, 1.0::DOUBLE AS largest, 64::BIGINT AS dim FROM names WHERE name <> ''"),
    "fp16_error": Query(fp16_error, f"WITH h AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, {_HALF} AS h FROM embeddings) SELECT vec_id, round(list_sum(h), 9) AS total, round(list_max(list_transform(list_zip(v, h), lambda x: abs(x[1] - x[2]))), 9) AS error FROM h"),
    "int8_products": Query(int8_products, f"WITH {_STEPS} SELECT a.vec_id AS a, b.vec_id AS b, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS product, len(a.q) AS bytes FROM bytes a JOIN bytes b ON b.vec_id BETWEEN a.vec_id + 1 AND a.vec_id + 7"),
    "conversion_check": Query(conversion_check, f"""
WITH {_STEPS}, e AS (SELECT CAST(embedding AS DOUBLE[]) AS a, {_HALF} AS h FROM embeddings),
k AS (SELECT 'fp32' AS kind, 0.999 AS least, a, list_transform(a, lambda x: round(x * 10000) / 10000) AS b FROM e UNION ALL SELECT 'fp16', 0.99, a, h FROM e UNION ALL SELECT 'int8', 0.95, v, list_transform(range(1, len(v) + 1), lambda i: q[i] * steps[i]) FROM bytes, steps),
c AS (SELECT kind, least, list_dot_product(a, b) / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b))) AS cosine, list_max(list_transform(list_zip(a, b), lambda x: abs(x[1] - x[2]))) AS gap FROM k)
SELECT kind, count(*) AS rows, round(min(cosine), 6) AS min_cosine, round(max(gap), 6) AS max_difference, min(cosine) > any_value(least) AS ok FROM c GROUP BY kind"""),
}
