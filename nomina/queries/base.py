"""Frames that several queries share, in Spark and as SQL.

The tables have no names, hits or scores of their own, so these stand in: names
are fixed examples and the first words of documents, results and hits follow
from event numbers, and pairs are neighbouring embeddings. Where one expression
is valid in both dialects it is written once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


def merged(*parts: dict[str, Query]) -> dict[str, Query]:
    out: dict[str, Query] = {}
    for part in parts:
        if out.keys() & part.keys():
            raise ValueError(f"queries named twice: {sorted(out.keys() & part.keys())}")
        out |= part
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*[F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


NAMES = [
    ("n01", "Custody Bank of Japan, Ltd.", "ORGANIZATION"), ("n02", "PUBLIC COMPANY", "ORGANIZATION"), ("n03", "Acme LTD Trading", "ORGANIZATION"),
    ("n04", "Acme International Management Co.", "ORGANIZATION"), ("n05", "Acme INTL Corp.", "ORGANIZATION"), ("n06", "Bank of the West", "ORGANIZATION"),
    ("n07", "of the", "ORGANIZATION"), ("n08", "A B C D", "ORGANIZATION"), ("n09", "A B C", "ORGANIZATION"), ("n10", "Бычков Владимир Петрович", "PERSON"),
    ("n11", "Jose Luis Sanz Ruiz", "PERSON"), ("n12", "John Smith", "PERSON"), ("n13", "John William Smith", "PERSON"),
    ("n14", "Acme Trading Company, Ltd.", "ORGANIZATION"), ("n15", "Müller-Öl, Inc.", "ORGANIZATION"), ("n16", "John W Smith", "PERSON"),
    ("n17", "Smith, J.", "PERSON"), ("n18", "", "PERSON"), ("n19", "12345", "ORGANIZATION"), ("n20", "   ", "PERSON"), ("n21", "[\\]^_", "PERSON"),
    ("n22", "Иванов Ivan", "PERSON"), ("n23", "日本銀行", "ORGANIZATION"), ("n24", "نينتندو", "ORGANIZATION"), ("n25", "닌텐도", "ORGANIZATION"),
    ("n26", "Ελλάς ABC", "ORGANIZATION"), ("n27", "é", "PERSON"), ("n28", "ç", "PERSON"), ("n29", "日", "PERSON"), ("n30", "ABC абв", "PERSON"),
    ("n31", "Nintendo 任天堂", "ORGANIZATION"), ("n32", "GMBH", "ORGANIZATION"), ("n33", "Siemens  AG ", "ORGANIZATION"), ("n34", "ქართული", "PERSON"),
    ("n35", "Investment Services and Technologies LLC", "ORGANIZATION"), ("n36", "Dev Mfg Svcs, Inc", "ORGANIZATION"), ("n37", "שלום", "PERSON"),
]


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, name, record_type``."""
    fixed = F.broadcast(spark.createDataFrame(NAMES, "id string, name string, record_type string"))
    own = F.slice(F.filter(F.split("text", r"\s+"), lambda w: w != ""), F.lit(1), (2 + F.col("doc_id") % 4).cast("int"))
    docs = table(spark, sf_dir, "documents").filter("text is not null")
    kind = F.when(F.col("doc_id") % 2 == 0, "PERSON").otherwise("ORGANIZATION")
    return fixed.unionByName(docs.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), F.array_join(own, " ").alias("name"), kind.alias("record_type")))


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


WITH_NAMES = (
    "names AS (SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(_quoted, row)) + ")" for row in NAMES) + ") v(id, name, record_type)"
    r" UNION ALL SELECT 'd' || doc_id, array_to_string(list_slice(list_filter(string_split_regex(text, '\s+'), lambda w: w <> ''), 1, 2 + doc_id % 4), ' '),"
    " CASE WHEN doc_id % 2 = 0 THEN 'PERSON' ELSE 'ORGANIZATION' END FROM documents WHERE text IS NOT NULL)"
)

RESULTS = {
    "case_id": "event_id",
    "record_type": "CASE WHEN event_id % 3 = 0 THEN 'PERSON' ELSE 'ORGANIZATION' END",
    "variant_type": "event_type",
    "query_name_type": "CASE event_id % 5 WHEN 0 THEN 'primary_Latin' WHEN 1 THEN 'alias_Cyrillic' WHEN 2 THEN 'alias_Latin' WHEN 3 THEN 'primary' ELSE 'alias_Greek_x' END",
    "name_rank": "CASE WHEN event_id % 7 < 2 THEN NULL ELSE CAST(1 + (event_id * 13) % 11 * (event_id % 4) AS INTEGER) END",
    "emb_rank": "CASE WHEN event_id % 11 = 3 THEN NULL ELSE CAST(1 + (event_id * 17) % 5 * (event_id % 6) * (event_id % 13) AS INTEGER) END",
    "name_score": "CAST((event_id * 37) % 101 AS INTEGER)",
    "emb_score": "CASE WHEN event_id % 6 = 0 THEN NULL ELSE CAST((event_id * 53) % 101 AS INTEGER) END",
    "name_total": "CAST(event_id % 17 AS INTEGER)",
    "emb_total": "CAST(event_id % 23 AS INTEGER)",
    "emb_ms": "value",
}
HITS = {
    "case_id": "CAST(floor(event_id / 16) AS BIGINT)",
    "mode": "CASE WHEN event_id % 16 < 8 THEN 'name' ELSE 'emb' END",
    "ordinal": "CAST(event_id % 8 AS INTEGER)",
    "entity_id": "(event_id * 31) % 23",
    "gnr_score": "CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST((event_id * 37) % 101 AS INTEGER) END",
    "emb_score": "CASE WHEN event_id % 6 = 0 THEN NULL WHEN event_id % 6 = 1 THEN 0 ELSE CAST((event_id * 53) % 101 AS INTEGER) END",
    "cosine": "round((event_id * 71) % 200 / 100.0 - 1, 2)",
}
#: Expected entities: of each case of the hits, its number's.
EXPECTED = {"case_id": "event_id", "expected_entity_id": "(event_id * 7) % 23"}


def _derived(spark: SparkSession, sf_dir: str, columns: dict[str, str]) -> DataFrame:
    return table(spark, sf_dir, "events").select(*[F.expr(e).alias(c) for c, e in columns.items()])


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derived(spark, sf_dir, RESULTS)


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derived(spark, sf_dir, HITS).withColumn("cosine", F.col("cosine").cast("double"))


def expected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derived(spark, sf_dir, EXPECTED)


def _sql(columns: dict[str, str]) -> str:
    return "SELECT " + ", ".join(f"{e} AS {c}" for c, e in columns.items()) + " FROM events"


WITH_RESULTS = f"results AS ({_sql(RESULTS)})"
WITH_HITS = f"hits AS (SELECT * REPLACE (CAST(cosine AS DOUBLE) AS cosine) FROM ({_sql(HITS)})), expected AS ({_sql(EXPECTED)})"


def aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, entity, name, v``: an embedding for each alias, labels as entities."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.col("label").cast("bigint").alias("entity"), F.concat(F.lit("n"), F.col("vec_id").cast("string")).alias("name"), F.col("embedding").alias("v"))


WITH_ALIASES = "aliases AS (SELECT vec_id AS id, CAST(label AS BIGINT) AS entity, 'n' || vec_id AS name, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"

_GNR = "CASE WHEN (a + 3 * b) % 9 = 0 THEN NULL ELSE CAST((a * 29 + b * 7) % 101 AS INTEGER) END"
_TYPE = "CASE WHEN ea = eb AND (a + b) % 2 = 0 THEN 'within_entity_cross_script' WHEN ea = eb THEN 'within_entity_same_script' ELSE 'cross_entity_embedding_match' END"


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored pairs of each embedding and the six after it."""
    x = aliases(spark, sf_dir).select("id", "entity", "v")
    a = x.select(F.col("id").alias("a"), F.col("entity").alias("ea"), F.col("v").alias("va"), F.explode(F.sequence(F.lit(1), F.lit(6))).alias("k"))
    b = x.select(F.col("id").alias("b"), F.col("entity").alias("eb"), F.col("v").alias("vb"))
    rows = a.join(b, F.col("b") == F.col("a") + F.col("k"))
    return rows.select(
        F.expr("concat('n', cast(a as string))").alias("name_a"), F.expr("concat('n', cast(b as string))").alias("name_b"), F.col("ea").alias("entity_a"), F.col("eb").alias("entity_b"),
        F.expr("ea = eb").alias("same_entity"), F.expr(_TYPE).alias("pair_type"), F.expr(_GNR).alias("gnr_score"), F.round(vectors.cosine(F.col("va"), F.col("vb")), 6).alias("cosine_sim"),
    )


WITH_PAIRS = (
    "near AS (SELECT x.vec_id AS a, y.vec_id AS b, CAST(x.label AS BIGINT) AS ea, CAST(y.label AS BIGINT) AS eb, CAST(x.embedding AS DOUBLE[]) AS va, CAST(y.embedding AS DOUBLE[]) AS vb"
    " FROM embeddings x JOIN embeddings y ON y.vec_id BETWEEN x.vec_id + 1 AND x.vec_id + 6),"
    f" pairs AS (SELECT 'n' || a AS name_a, 'n' || b AS name_b, ea AS entity_a, eb AS entity_b, ea = eb AS same_entity, {_TYPE} AS pair_type, {_GNR} AS gnr_score,"
    " round(list_dot_product(va, vb), 6) AS cosine_sim FROM near)"
)
