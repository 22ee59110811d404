"""Hits to ranks: flattening responses, ordering hits, placing the expected one.

A hit is a row of ``case_id, mode, ordinal, entity_id, gnr_score, emb_score``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FEATURE = "array<struct<SCORE:int,SCORE_BUCKET:string,CANDIDATE_FEAT_DESC:string>>"
RESPONSE = (
    "RESOLVED_ENTITIES array<struct<"
    "ENTITY:struct<RESOLVED_ENTITY:struct<ENTITY_ID:bigint>>,"
    f"MATCH_INFO:struct<MATCH_KEY:string,MATCH_LEVEL_CODE:string,FEATURE_SCORES:struct<NAME:{FEATURE},NAME_EMBEDDING:{FEATURE},BIZNAME_EMBEDDING:{FEATURE}>>>>"
)


def flatten(responses: DataFrame, response: str = "response") -> DataFrame:
    """A hit for each resolved entity with an id, ordinals from 0 in the
    response's order: the first NAME score, and the first NAME_EMBEDDING score or
    else the first BIZNAME_EMBEDDING one."""
    parsed = responses.withColumn("_r", F.from_json(response, RESPONSE))
    keys = [c for c in responses.columns if c != response]
    rows = parsed.select(*keys, F.posexplode("_r.RESOLVED_ENTITIES").alias("ordinal", "e"))
    scores = F.col("e.MATCH_INFO.FEATURE_SCORES")
    first = lambda f: F.get(scores[f], F.lit(0))["SCORE"]
    return rows.select(
        *keys, "ordinal", F.col("e.ENTITY.RESOLVED_ENTITY.ENTITY_ID").alias("entity_id"),
        first("NAME").alias("gnr_score"), F.coalesce(first("NAME_EMBEDDING"), first("BIZNAME_EMBEDDING")).alias("emb_score"),
    ).filter("entity_id is not null")


def score(zero_counts: bool = True) -> Column:
    """A hit's score: embedding, else name, else 0. Unless ``zero_counts``, an
    embedding score of 0 counts as missing."""
    emb = F.col("emb_score") if zero_counts else F.nullif(F.col("emb_score"), F.lit(0))
    return F.coalesce(emb, F.col("gnr_score"), F.lit(0))


def ranked(hits: DataFrame, by: str = "score", keys: tuple[str, ...] = ("case_id", "mode")) -> DataFrame:
    """``hits`` with ``rank``: by score descending, equal ones as they arrived,
    or in order of arrival (``by="ordinal"``)."""
    order = {"score": [score().desc(), F.col("ordinal")], "ordinal": [F.col("ordinal")]}[by]
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def placed(ranks: DataFrame, expected: DataFrame, keys: tuple[str, ...] = ("case_id", "mode")) -> DataFrame:
    """For each case in ``expected`` (``case_id, expected_entity_id``) and mode,
    the ranks of the expected entity and of the first other one, null if absent,
    and the number of hits. Cases without hits have no row here."""
    rows = ranks.join(expected, "case_id")
    hit = F.col("entity_id") == F.col("expected_entity_id")
    return rows.groupBy(*keys).agg(
        F.min(F.when(hit, F.col("rank"))).alias("positive_rank"),
        F.min(F.when(~hit, F.col("rank"))).alias("negative_rank"),
        F.min_by(F.when(hit, score(False)), F.when(hit, F.col("rank"))).alias("positive_score"),
        F.count(F.lit(1)).alias("total"),
    )


def scenario(positive: Column, negative: Column) -> Column:
    return (
        F.when(positive.isNotNull() & negative.isNotNull(), F.when(positive < negative, "both_found_correct_order").otherwise("both_found_wrong_order"))
        .when(positive.isNotNull(), "only_positive_found")
        .when(negative.isNotNull(), "only_negative_found")
        .otherwise("neither_found")
    )


def rank_bucket(rank: Column) -> Column:
    return (
        F.when(rank.isNull(), "not_found").when(rank <= 1, "1").when(rank <= 5, "2-5").when(rank <= 10, "6-10")
        .when(rank <= 50, "11-50").when(rank <= 100, "51-100").otherwise(">100")
    )


def keep_first(rows: DataFrame, keys: list[Column | str], order: list[Column | str]) -> DataFrame:
    """The first row of each key by an explicit order; never an arbitrary one."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_nth", nth).filter("_nth = 1").drop("_nth")


def first_n(rows: DataFrame, keys: list[Column | str], order: list[Column | str], n: int) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_nth", nth).filter(F.col("_nth") <= n).drop("_nth")


def average_rank(value: Column | str, by: list[Column | str] = ()) -> Column:
    """Ranks with ties sharing their mean."""
    value = F.col(value) if isinstance(value, str) else value
    ties = F.count(F.lit(1)).over(Window.partitionBy(*by, value))
    return F.rank().over(Window.partitionBy(*by).orderBy(value)) + (ties - 1) / 2.0


def contribution(hits: DataFrame) -> DataFrame:
    """By case, what the embedding did for its hits (``retrieved``: it was among
    the candidates): retrieved and scored, retrieved only, or neither."""
    scored = F.col("emb_score").isNotNull()
    return hits.groupBy("case_id").agg(
        F.count_if(F.col("retrieved") & scored).alias("retrieved_and_scored"), F.count_if(F.col("retrieved") & ~scored).alias("retrieved_only"), F.count_if(~F.col("retrieved")).alias("neither")
    )


def name_overlap(found: DataFrame, other: DataFrame, top: int = 10) -> DataFrame:
    """``query_id, common, percent, names``: of two searches' results
    (``query_id, rank, name``), the names that both have among their first
    ``top``, how many, and as a percentage of ``top``. Null names count for
    nothing; a query that only one search knows shares none."""
    lists = lambda f, c: f.filter(F.col("rank") <= top).groupBy("query_id").agg(F.collect_set("name").alias(c))
    both = lists(found, "x").join(lists(other, "y"), "query_id", "full")
    none = F.array().cast("array<string>")
    shared = F.array_sort(F.array_intersect(F.coalesce("x", none), F.coalesce("y", none)))
    return both.select("query_id", F.size(shared).cast("long").alias("common"), (100.0 * F.size(shared) / top).alias("percent"), F.array_join(shared, ",").alias("names"))
