"""Whole workloads from the operators: loading, validation and alignment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..functions.vectors import Encoder, encode_names
from ..operators import metrics, pairs, ranking, records
from ..operators.ranking import keep_first


def enrich(recs: DataFrame, encoder: Encoder, dim: int | None = None) -> DataFrame:
    """Records' names with their vectors, one array for each record, persons'
    apart from organisations'; records of other types keep nulls."""
    named = encode_names(records.names(recs), "name", encoder, dim)
    entry = F.struct(F.col("name").alias("label"), "embedding")
    made = named.groupBy("data_source", "record_id", "record_type").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", entry.alias("e")))), lambda x: x["e"]).alias("v"))
    of = lambda kind: F.when(F.col("record_type") == kind, F.col("v"))
    return made.select("data_source", "record_id", of("PERSON").alias("name_embeddings"), of("ORGANIZATION").alias("bizname_embeddings"))


def variants(cases: DataFrame, most: int = 3) -> DataFrame:
    """Variant cases of validation cases, at most ``most`` for each in the order
    of the rules; repeated queries of a record count once."""
    name = F.col("query_name")
    made = F.when(F.col("record_type") == "PERSON", text.person_variants(name)).otherwise(text.business_variants(name))
    rows = cases.select("test_case_id", name.alias("original_name"), F.col("record_id").alias("expected_record_id"), "data_source", "record_type", F.posexplode(F.slice(made, 1, most)).alias("nth", "v"))
    rows = rows.select("*", F.col("v.variant").alias("variant_query"), F.col("v.variant_type").alias("variant_type"), F.lit("automated").alias("source")).drop("v")
    return keep_first(rows, [F.lower("variant_query"), "expected_record_id"], ["test_case_id", "nth"]).drop("nth", "test_case_id")


# Query, original name, record, type of record, type and reason of variant.
MANUAL = (
    ("Ryazan Refinery", "RNPK JSC", "NK-6JHQE4LmZLd9PATFPLNcMW", "ORGANIZATION", "fuzzy_company_name", "Query missing multiple significant words"),
    ("Aberdeen Asset Management Ltd", "ABERDEEN ASSET MANAGERS LIMITED", "NK-52eqKSj5yz2z6yoxpJGnq6", "ORGANIZATION", "word_form_variation", "'Managers' vs 'Management', 'Limited' vs 'Ltd'"),
    ("Custody Bank Japan", "Custody Bank of Japan, Ltd.", "NK-39MNPnyuTJTsWuf4Prniyc", "ORGANIZATION", "legal_suffix_removed", "Removed 'of' and 'Ltd' from company name"),
    ("Vladimir Bychkov", "Бычков Владимир Петрович", "NK-3NULJaQxASzh2kVjbFYdcx", "PERSON", "patronymic_dropped", "Latin transliteration without patronymic"),
    ("Bychkov Vladimir", "Бычков Владимир Петрович", "NK-3NULJaQxASzh2kVjbFYdcx", "PERSON", "name_order_variation", "Last name first, no patronymic"),
    ("Vladamir Bychkov", "Бычков Владимир Петрович", "NK-3NULJaQxASzh2kVjbFYdcx", "PERSON", "spelling_variation", "Typo: 'Vladamir' vs 'Vladimir' (a instead of i)"),
)
MANUAL_SOURCE = "OPEN_SANCTIONS"


def manual_variants(spark: SparkSession, loaded: DataFrame | None = None) -> DataFrame:
    """Hand-written variant cases; those of records in ``loaded`` (``record_id``)
    if it is given."""
    rows = spark.createDataFrame(list(MANUAL), "variant_query string, original_name string, expected_record_id string, record_type string, variant_type string, description string")
    rows = rows.withColumns({"data_source": F.lit(MANUAL_SOURCE), "source": F.lit("manual")})
    return rows if loaded is None else rows.join(loaded.select(F.col("record_id").alias("expected_record_id")).distinct(), "expected_record_id", "left_semi")


def all_variants(cases: DataFrame, most: int = 3) -> DataFrame:
    """Automated and manual variant cases, the automated one where both have a
    record's query."""
    manual = manual_variants(cases.sparkSession, cases)
    both = variants(cases, most).withColumn("_ord", F.lit(0)).unionByName(manual.withColumn("_ord", F.lit(1)), allowMissingColumns=True)
    return keep_first(both, [F.lower("variant_query"), "expected_record_id"], ["_ord", "variant_type"]).drop("_ord")


def validate(cases: DataFrame, hits: DataFrame, by: str = "score") -> DataFrame:
    """One result for each case from its hits in both modes; a case without hits
    in a mode has a null rank there."""
    expected = cases.select("case_id", "expected_entity_id")
    found = ranking.placed(ranking.ranked(hits, by), expected)
    side = lambda m: found.filter(F.col("mode") == m).select("case_id", F.col("positive_rank").alias(f"{m}_rank"), F.col("positive_score").alias(f"{m}_score"), F.col("total").alias(f"{m}_total"))
    return cases.join(side("name"), "case_id", "left").join(side("emb"), "case_id", "left")


def report(results: DataFrame) -> DataFrame:
    """The headline metrics in one row."""
    return metrics.retrieval(results).crossJoin(metrics.ndcg(results)).crossJoin(metrics.rescue(results).drop("both_correct"))


def _section(frame: DataFrame, name: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """A small report as rows ``section, part, metric, value``; ``part`` names
    the row by its keys."""
    values = [c for c in frame.columns if c not in keys]
    part = F.concat_ws(":", *[F.col(k).cast("string") for k in keys]) if keys else F.lit("")
    rows = frame.select(part.alias("part"), *[F.col(c).cast("double").alias(c) for c in values])
    long = rows.unpivot(["part"], values, "metric", "value").filter("value is not null")
    return long.select(F.lit(name).alias("section"), "part", "metric", "value")


def full_report(results: DataFrame, placed: DataFrame) -> DataFrame:
    """Everything that is said of a validation, as ``section, part, metric,
    value``: one result a case (see ``metrics``) and, for every case and mode, the
    places of its expected and other entities (``ranking.placed`` with
    ``scenario``). Every section is a small aggregate; metrics over nothing have
    no row."""
    both = results.selectExpr("name_rank as name", "emb_rank as emb").unpivot([], ["name", "emb"], "mode", "rank")
    bars = both.groupBy("mode", ranking.rank_bucket(F.col("rank")).alias("bucket")).agg(F.count(F.lit(1)).alias("cases"))
    parts = [
        _section(metrics.retrieval(results), "retrieval"),
        _section(metrics.ndcg(results), "ndcg"),
        _section(metrics.rescue(results), "rescue"),
        _section(metrics.impact(results, top=False), "impact_found"),
        _section(metrics.impact(results, top=True), "impact_rank1"),
        *(_section(metrics.volume(results, m), "volume", ()).withColumn("part", F.lit(m)) for m in ("name", "emb")),
        _section(metrics.relative_ranking(placed, ["mode"]), "relative_ranking", ("mode",)),
        _section(metrics.breakdown(results), "breakdown", ("dimension", "value")),
        _section(bars, "rank_distribution", ("mode", "bucket")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def evaluate(cases: DataFrame, responses: DataFrame, by: str = "score") -> DataFrame:
    """``full_report`` of search responses (``case_id, mode, response``) to
    cases."""
    hits = ranking.flatten(responses)
    placed = ranking.placed(ranking.ranked(hits, by), cases.select("case_id", "expected_entity_id"))
    return full_report(validate(cases, hits, by), placed.withColumn("scenario", ranking.scenario(F.col("positive_rank"), F.col("negative_rank"))))


def align(aliases: DataFrame, embeddings: DataFrame, mapping: DataFrame, theta: float = 0.43) -> DataFrame:
    """Entities' aliases (``id, entity, ord, name, script, v``) to scored pairs:
    within and across entities, deduplicated, with both scores."""
    both = pairs.all_pairs(pairs.within_entity(aliases), pairs.cross_entity(aliases, theta))
    kind = F.when(F.col("same_entity"), 0).otherwise(1)
    ordered = both.withColumn("ord", F.struct(kind, "name_a", "name_b", "entity_a", "entity_b"))
    return pairs.scored(pairs.deduplicated(ordered, "ord").drop("ord"), embeddings, mapping)
