"""Queries on graded name scores, names against entities, and resolution."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lexical, resolution, scoring
from ..session import checkpoint
from .base import WITH_NAMES, Query, names, table

SHARE, LEAST = 0.4, 75


def name_scores(spark, d):
    """Pairs of names that share a fifth of their three-letter stretches, scored."""
    n = names(spark, d).filter("name <> ''").select(F.col("name").alias("node")).distinct()
    return lexical.scored_sets(n.select("node", resolution.trigrams(F.col("node")).alias("words"), F.lit(True).alias("asks")), 0.2)


def _records(spark, d):
    return names(spark, d).select(F.col("id").alias("record_id"), "name", F.lit(None).cast("array<double>").alias("v"))


def resolved_entities(spark, d):
    """Records in two batches, those whose id ends in an even digit first."""
    r = _records(spark, d)
    first = F.substring("record_id", -1, 1).isin(*"02468")
    stored = checkpoint(resolution.resolve(r.filter(first), share=SHARE, least=LEAST))
    return resolution.resolve(r.filter(~first), stored, share=SHARE, least=LEAST).select("record_id", "entity_id")


def why_entity(spark, d):
    """Every name against the entities of the three records after its own, a
    document's entity being its number modulo 250."""
    n = names(spark, d).filter("id like 'd%'").select(F.substring("id", 2, 20).cast("long").alias("doc"), "name")
    asked = n.select("doc", "name", F.explode(F.array(*[F.pmod(F.col("doc") + k, F.lit(250)) for k in range(1, 4)])).alias("entity"))
    return scoring.why(asked, n.select(F.pmod("doc", F.lit(250)).alias("entity"), "name")).select("doc", "entity", "name", "score", "alias", "bucket", F.concat_ws(" ", "agree").alias("agree"))


# SQL. Edit distances count bytes there: accented letters become capitals, which
# lower-cased names lack.
_ONE_BYTE = "translate({}, 'ßäçèéêíñóöüáàâëîïôúùûœæ', 'ABCDEFGHIJKLMNOPQRSTUVW')"
_WORDS = r"list_filter(list_transform(string_split_regex(lower({}), '\s+'), lambda w: regexp_replace(w, '^[.,]+|[.,]+$', '', 'g')), lambda w: w <> '')"
_U, _V = (_ONE_BYTE.format(w) for w in "uv")
_KEPT = f"(100 * (greatest(length(u), length(v)) - levenshtein({_U}, {_V}))) // greatest(length(u), length(v))"
_AGREE = f"CASE WHEN u = v THEN 100 WHEN least(length(u), length(v)) = 1 AND u[1] = v[1] THEN 80 WHEN {_KEPT} >= 60 THEN {_KEPT} ELSE 0 END"


def graded(pairs: str) -> str:
    """CTEs that end in ``graded (x, y, score)``: every one-to-one matching of the
    words of the distinct name pairs in ``pairs`` (``x, y``) is tried."""
    return f"""g0 AS (SELECT x, y, {_WORDS.format("x")} AS us, {_WORDS.format("y")} AS vs FROM (SELECT DISTINCT x, y FROM {pairs})),
g1 AS (SELECT x, y, len(us) AS m, len(vs) AS n, list_transform(us, lambda u: list_transform(vs, lambda v: {_AGREE})) AS s FROM g0 WHERE len(us) > 0 AND len(vs) > 0),
g2 AS (SELECT x, y, m, n, s, 0 AS i, CAST(0 AS BIGINT) AS used, 0 AS total, true AS kept, 0 AS last FROM g1
  UNION ALL SELECT x, y, m, n, s, i + 1, CASE WHEN j > 0 THEN used + (1 << j) ELSE used END, total + CASE WHEN j > 0 THEN s[i + 1][j] ELSE 0 END, kept AND (j = 0 OR j > last), greatest(last, j)
  FROM g2, (SELECT CAST(unnest(range(0, 12)) AS INTEGER) AS j) WHERE i < m AND j <= n AND (j = 0 OR ((used >> j) & 1 = 0 AND s[i + 1][j] > 0))),
graded AS (SELECT x, y, CAST(max(2 * total // (m + n) - CASE WHEN kept THEN 0 ELSE 5 END) AS INTEGER) AS score FROM g2 WHERE i = m GROUP BY x, y HAVING max(2 * total // (m + n) - CASE WHEN kept THEN 0 ELSE 5 END) > 0)"""


_TRIGRAMS = f"list_distinct(flatten(list_transform({_WORDS.format('name')}, lambda w: list_transform(range(1, length(w) + 1), lambda i: ('^' || w || '$')[i : i + 2]))))"
_NEAR = f"""t AS (SELECT name, {_TRIGRAMS} AS g FROM (SELECT DISTINCT name FROM names)), e AS (SELECT name, len(g) AS size, unnest(g) AS token FROM t),
c AS (SELECT a.name AS x, b.name AS y, a.size AS p, b.size AS q, count(*) AS common FROM e a JOIN e b ON a.token = b.token AND a.name < b.name GROUP BY ALL),
near AS (SELECT x, y FROM c WHERE common / (p + q - common)::DOUBLE >= {{}})"""
_BUCKET = "CASE WHEN score >= 80 THEN 'same' WHEN score >= 50 THEN 'close' WHEN score >= 30 THEN 'likely' WHEN score >= 20 THEN 'plausible' WHEN score >= 10 THEN 'unlikely' END"

QUERIES = {
    "name_scores": Query(name_scores, f"WITH RECURSIVE {WITH_NAMES}, {_NEAR.format(0.2)}, {graded('near')} SELECT near.x AS name_a, near.y AS name_b, score FROM near LEFT JOIN graded USING (x, y)"),
    "resolved_entities": Query(resolved_entities, f"""WITH RECURSIVE {WITH_NAMES}, {_NEAR.format(SHARE)}, {graded('near')}, f AS (SELECT name, min(id) AS first FROM names GROUP BY name),
l AS (SELECT a.first AS u, b.first AS v FROM graded JOIN f a ON a.name = x JOIN f b ON b.name = y WHERE score >= {LEAST}), k AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
r AS (SELECT first AS node, first AS reached FROM f UNION SELECT node, v FROM r JOIN k ON reached = u), z AS (SELECT node, min(reached) AS entity_id FROM r GROUP BY node)
SELECT id AS record_id, entity_id FROM names JOIN f USING (name) JOIN z ON node = first"""),
    "why_entity": Query(why_entity, f"""WITH RECURSIVE {WITH_NAMES}, n AS (SELECT CAST(substr(id, 2) AS BIGINT) AS doc, name FROM names WHERE id LIKE 'd%'), q AS (SELECT doc, name, (doc + unnest([1, 2, 3])) % 250 AS entity FROM n),
a AS (SELECT DISTINCT doc % 250 AS entity, name AS alias FROM n), p AS (SELECT DISTINCT q.entity, q.name AS x, alias AS y FROM q JOIN a USING (entity)), {graded('p')},
b AS (SELECT p.entity, x, y, score FROM p JOIN graded USING (x, y) QUALIFY row_number() OVER (PARTITION BY p.entity, x ORDER BY score DESC, encode(y)) = 1)
SELECT doc, q.entity, q.name, score, y AS alias, {_BUCKET} AS bucket, CASE WHEN y IS NULL THEN '' ELSE array_to_string(list_filter({_WORDS.format("q.name")}, lambda u: len(list_filter({_WORDS.format("y")}, lambda v: {_AGREE} > 0)) > 0), ' ') END AS agree
FROM q LEFT JOIN b ON b.entity = q.entity AND x = q.name"""),
}
