"""The registered queries: each applies one operator, with production
parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, langid, mixing, packing, pii, quality, sharding, simhash, spelling, substring, tokencount, topk, toxicity

from .common import remainder

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer() -> dict[str, str]:
    """The public tokenizer's files on this machine, as ``packing.pack`` takes them."""
    import public_tokenizers

    path = public_tokenizers.path
    return {"path": path("byte_bpe_50k.json"), "ranks": path("byte_bpe_50k.tiktoken"), "pattern": public_tokenizers.PATTERN}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_threshold_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = toxicity.fit(toxicity.training_rows(docs, labels))
    held_out = F.coalesce(remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out")
    return toxicity.score(docs, model).select("doc_id", held_out, "score", "predicted", F.size("passages").alias("n_passages"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = pii.detect(docs, pii.train(docs))
    return found.select("doc_id", *(f"n_{k}" for k in pii.KINDS), F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    forest = quality.fit(docs, _table(spark, sf_dir, "labels"))
    return quality.judge(docs, forest).select("doc_id", *quality.COUNTS, "base_failed", "kept", "anomaly")


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    return mixing.mix(mixing.quality_weights(docs, labels)).drop("row")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), **tokenizer()).drop("ids")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digest(substring.remove_repeats(_table(spark, sf_dir, "documents")))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


#: Placement of documents: 64 shards over a table a hundred times as large.
SHARDS, SLOTS = [f"shard-{i:03d}" for i in range(64)], 6421


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return sharding.place(docs.select("doc_id", "source"), "doc_id", SHARDS, SLOTS).select("doc_id", "source", "slot", "shard")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.learn(langid.training_rows(docs)))
    held_out = F.coalesce(remainder("doc_id", 3) == 1, F.lit(False)).alias("held_out")
    return found.select("doc_id", held_out, "lang_pred", "score", "rejected")


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokencount.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_table(spark, sf_dir, "documents"))


OP1_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: CAST(floor(64 * x) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (
  SELECT q.rid, q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda x: x[1] * x[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.rid <> q.rid AND len(q.v) = len(c.v)),
r AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""

#: The table is filled here; the SQL repeats the hashing and the look-up.
OP9_SQL = f"""
WITH k AS (
  SELECT doc_id, source, CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) % {SLOTS} AS INTEGER) AS slot
  FROM documents)
SELECT doc_id, source, slot, 'shard-' || lpad(CAST({sharding.fill(SHARDS, SLOTS)}[slot + 1] AS VARCHAR), 3, '0') AS shard FROM k
"""

OP5_SQL = r"""
WITH marks AS (SELECT doc_id, min(quality) AS q FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
d AS (SELECT d.doc_id, d.source, CAST(len(regexp_extract_all(coalesce(d.text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
  CASE WHEN q >= 1 THEN 1.0 WHEN q < 1 THEN 0.1 ELSE 0.5 END::DOUBLE AS weight,
  md5('42|' || coalesce(CAST(d.doc_id AS VARCHAR), '') || '|' || md5(coalesce(d.text, ''))) AS draw FROM documents d LEFT JOIN marks USING (doc_id)),
k AS (SELECT *, -ln((('0x' || substr(draw, 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0) / weight AS key FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS turn FROM k GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][1 + turn % 3]::DOUBLE AS w, 3 * source_size::DOUBLE AS cap FROM s),
v AS (SELECT *, cap / w AS level, coalesce(sum(cap) OVER b, 0) AS held, sum(w) OVER () - coalesce(sum(w) OVER b, 0) AS open, sum(source_size) OVER () AS total
  FROM w WINDOW b AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, (SELECT (total - held) / open FROM v WHERE level > (total - held) / open ORDER BY level, source NULLS LAST LIMIT 1) AS flow FROM v),
t AS (SELECT source, source_size, CASE WHEN flow IS NULL OR level <= flow THEN cap ELSE flow * w END AS target FROM f),
p AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target) AS BIGINT) // source_size ELSE 0 END AS epochs FROM t),
r AS (SELECT k.*, p.source_size, p.target, p.epochs, CAST(floor(p.target) AS BIGINT) - p.epochs * p.source_size AS budget,
  sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id NULLS LAST, k.size ROWS UNBOUNDED PRECEDING) AS upto
  FROM k JOIN p ON k.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, CAST(epochs * size + least(size, greatest(0, budget - upto + size)) AS BIGINT) AS taken FROM r
"""


OP7_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT rid, doc_id, i AS pos, array_to_string(ws[i : i + 49], ' ') AS win
  FROM (SELECT rid, doc_id, ws, unnest(range(1, greatest(1, len(ws) - 48))) AS i FROM d WHERE doc_id IS NOT NULL)),
g AS (SELECT win, min(doc_id) AS least FROM s GROUP BY win),
f AS (SELECT rid, pos FROM s JOIN g USING (win) WHERE doc_id > least),
p AS (SELECT rid, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS pos FROM d),
c AS (
  SELECT p.*, coalesce(p.pos - max(f.pos) OVER (PARTITION BY p.rid ORDER BY p.pos) < 50, false) AS gone
  FROM p LEFT JOIN f ON p.rid = f.rid AND p.pos = f.pos),
k AS (SELECT rid, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (NOT gone) AS kept FROM c GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (rid)
"""

#: Every phrase of up to four words is laid out, counted and cut here.
OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
c AS (SELECT rid, lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM c),
s AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
g AS (SELECT lang, k, array_to_string(ws[i : i + k - 1], ' ') AS phrase FROM s, (VALUES (1), (2), (3), (4)) v(k) WHERE i + k - 1 <= len(ws)),
f AS (SELECT lang, k, phrase, count(*) AS n FROM g GROUP BY ALL HAVING count(*) >= 30),
t AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY lang),
x AS (SELECT lang, k, phrase, n AS a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1),
y AS (SELECT *, unnest(range(1, k)) AS cut FROM x),
z AS (
  SELECT y.lang, y.k, y.phrase, y.a, y.cut, p.n AS l, q.n AS r, CAST(2000000::HUGEINT * y.a // (p.n + q.n) AS BIGINT) AS score
  FROM y JOIN f p ON p.lang = y.lang AND p.phrase = array_to_string(ws[1 : cut], ' ') JOIN f q ON q.lang = y.lang AND q.phrase = array_to_string(ws[cut + 1 :], ' ')),
b AS (SELECT * FROM z QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
e AS (SELECT lang, a, ws, k, unnest(range(2, k)) AS size FROM x),
i AS (SELECT lang, a, ws, size, unnest(range(1, k - size + 2)) AS first FROM e),
m AS (SELECT lang, array_to_string(ws[first : first + size - 1], ' ') AS phrase, max(a) AS longer FROM i GROUP BY ALL),
o AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, encode(b.phrase)) AS rank FROM b LEFT JOIN m USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 80 * a)
SELECT lang, rank, phrase, a, l, r, t.n, score FROM o JOIN t USING (lang) WHERE rank <= 2000
"""

#: Words are one edit apart where one, or both at one place, lack a letter.
OP13_SQL = r"""
WITH RECURSIVE o AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{00C0}-\x{00FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
c AS (SELECT doc_id, run, count(*) AS n, encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run) AS b FROM o WHERE length(run) >= 7 GROUP BY doc_id, run),
bits AS (SELECT list(v ORDER BY i) AS crc FROM (
  SELECT i, list_reduce([i, 1, 2, 3, 4, 5, 6, 7, 8], lambda x, _: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END) AS v FROM (SELECT unnest(range(0, 256)) AS i))),
h AS (SELECT run, n, xor(4294967295, list_reduce(list_transform(range(0, octet_length(b) + 1), lambda i: CASE WHEN i = 0 THEN 4294967295 ELSE CAST('0x' || hex(b)[2 * i - 1 : 2 * i] AS BIGINT) END),
  lambda x, y: xor(x // 256, bits.crc[1 + CAST(xor(x % 256, y) AS INTEGER)]))) AS h FROM c, bits),
v AS (SELECT CASE WHEN h % 31 = 0 THEN run[1 : h % length(run)] || run[h % length(run) + 2 :] ELSE run END AS word, n FROM h),
w AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM v WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
g AS (SELECT word, n, i, word[1 : i - 1] || word[i + 1 :] AS less FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM w)),
p AS (
  SELECT a.word AS u, b.word AS v, b.n FROM g a JOIN g b ON a.i = b.i AND a.less = b.less AND a.word <> b.word
  UNION SELECT g.word, w.word, w.n FROM g JOIN w ON g.less = w.word
  UNION SELECT w.word, g.word, g.n FROM g JOIN w ON g.less = w.word),
k AS (SELECT u AS word, count(*) AS n_near, arg_min(v, (-n, encode(v))) AS best, max(n) AS best_n FROM p GROUP BY u),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 10 * w.n THEN best END AS form, CASE WHEN best_n >= 10 * w.n THEN best_n END AS form_n FROM w LEFT JOIN k USING (word)),
r AS (SELECT word, word AS root, 0 AS steps FROM f UNION ALL SELECT r.word, f.form, steps + 1 FROM r JOIN f ON r.root = f.word WHERE f.form IS NOT NULL),
e AS (SELECT word, arg_max(root, steps) AS root FROM r GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM f JOIN e USING (word)
"""

OPERATORS = (
    op1_threshold_topk, op2_toxicity, op3_pii, op4_quality_rules, op5_source_mixing,
    op6_packing, op7_substring_dedup, op8_simhash, op9_sharding, op10_language_id,
    op11_token_counts, op12_collocations, op13_spelling_variants,
)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in OPERATORS}


def oracle_sql() -> dict[str, str]:
    return {"op1_threshold_topk": OP1_SQL, "op5_source_mixing": OP5_SQL, "op7_substring_dedup": OP7_SQL, "op9_sharding": OP9_SQL, "op12_collocations": OP12_SQL, "op13_spelling_variants": OP13_SQL}
