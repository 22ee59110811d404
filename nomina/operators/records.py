"""Records: reading names out of them and shaping them for other stages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scripts, text

NAME = "struct<NAME_TYPE:string,NAME_FULL:string,NAME_ORG:string>"
RECORD = f"DATA_SOURCE string, RECORD_ID string, RECORD_TYPE string, NAMES array<{NAME}>"


def record_type(default: str | None = "UNKNOWN") -> Column:
    """Upper-cased type; ``default`` where it is missing."""
    return F.coalesce(F.upper(F.col("RECORD_TYPE")), F.lit(default))


def name_of(entry: Column, kind: Column, fallback: str = "NAME_FULL") -> Column:
    """The name in an entry of NAMES: NAME_FULL of a person; of others NAME_ORG,
    or else ``fallback``. Empty strings count as missing."""
    full, org = F.nullif(entry["NAME_FULL"], F.lit("")), F.nullif(entry["NAME_ORG"], F.lit(""))
    if fallback == "NAME_ORG":
        return F.when(kind == "PERSON", F.coalesce(full, org)).otherwise(F.coalesce(org, full))
    return F.when(kind == "PERSON", full).otherwise(F.coalesce(org, full))


def analyzed(records: DataFrame) -> DataFrame:
    """``records`` with the type, number of names, script and complexity of the
    first name, and whether there are others."""
    kind = record_type()
    first = F.coalesce(name_of(F.get(F.col("NAMES"), F.lit(0)), kind), F.lit(""))
    n = F.greatest(F.size(F.coalesce("NAMES", F.array().cast(f"array<{NAME}>"))), F.lit(0))
    return records.withColumns({"record_type": kind, "alias_count": n, "script": scripts.dominant_of_five(first), "complexity": text.complexity(first), "has_aliases": n > 1})


def of_type(records: DataFrame, kind: str = "both") -> DataFrame:
    kinds = {"person": ["PERSON"], "organization": ["ORGANIZATION"], "both": ["PERSON", "ORGANIZATION"]}[kind]
    return records.filter(record_type("PERSON").isin(kinds))


def with_aliases(records: DataFrame, least: int = 2) -> DataFrame:
    return records.filter(F.size("NAMES") >= least)


def names(records: DataFrame) -> DataFrame:
    """A row for each usable name: ``record_id, data_source, record_type, idx,
    name, kind, query_name_type, all_names``. ``idx`` counts usable names; the
    first entry of NAMES, usable or not, and those of type PRIMARY are primary.
    Everything comes from the record's own array: no row is moved."""
    rows = records.withColumn("_kind", record_type("PERSON"))

    def entry(e: Column, i: Column) -> Column:
        primary = (F.coalesce(F.upper(e["NAME_TYPE"]), F.lit("")) == "PRIMARY") | (i == 0)
        return F.struct(name_of(e, F.col("_kind"), "NAME_ORG").alias("name"), F.when(primary, "primary").otherwise("alias").alias("kind"))

    usable = F.filter(F.transform("NAMES", entry), lambda x: x["name"].isNotNull() & (F.trim(x["name"]) != ""))
    rows = rows.withColumn("_n", usable)
    out = rows.select("RECORD_ID", "DATA_SOURCE", "_kind", F.transform("_n", lambda x: x["name"]).alias("all_names"), F.posexplode("_n").alias("idx", "x"))
    return out.select(
        F.col("RECORD_ID").alias("record_id"), F.col("DATA_SOURCE").alias("data_source"), F.col("_kind").alias("record_type"), "idx", "x.name", "x.kind",
        F.concat_ws("_", "x.kind", scripts.majority(F.col("x.name"))).alias("query_name_type"), "all_names",
    )


def test_cases(named: DataFrame, sample_date: str) -> DataFrame:
    """Validation cases from ``names``: ids by place, all names of the record,
    no expected entity yet."""
    return named.select(
        F.concat(F.col("record_id"), F.lit("_name_"), F.col("idx").cast("string")).alias("test_case_id"), "record_id", "data_source", "record_type",
        F.col("name").alias("query_name"), "query_name_type", F.col("all_names").alias("all_aliases"), F.lit(None).cast("bigint").alias("expected_entity_id"),
        F.struct(F.col("idx").cast("bigint").alias("original_index"), F.lit(sample_date).alias("sample_date")).alias("metadata"),
    )


def loader_records(entities: DataFrame, source: str = "WIKIDATA", kind: str = "ORGANIZATION") -> DataFrame:
    """Entities (``entity_id, aliases``) as records whose names are the aliases."""
    made = F.transform("aliases", lambda a: F.struct(a["name"].alias("NAME_ORG")))
    return entities.select(F.lit(source).alias("DATA_SOURCE"), F.col("entity_id").alias("RECORD_ID"), F.lit(kind).alias("RECORD_TYPE"), made.alias("NAMES"))


def first_filled(*columns: str) -> Column:
    """The first of some columns that is neither null nor empty."""
    return F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in columns])


def ready(cases: DataFrame) -> DataFrame:
    """Cases whose entity is known; id 0 counts as unknown."""
    return cases.filter("expected_entity_id is not null and expected_entity_id <> 0")


def resolved(cases: DataFrame, record_entity: DataFrame) -> DataFrame:
    """Cases with the entity of their record; those without one drop out, see
    ``unresolved``."""
    known = record_entity.select("data_source", "record_id", F.col("entity_id").alias("expected_entity_id"))
    return cases.drop("expected_entity_id").join(known, ["data_source", "record_id"])


def unresolved(cases: DataFrame, record_entity: DataFrame) -> DataFrame:
    return cases.join(record_entity, ["data_source", "record_id"], "left_anti")


def entities_from_rows(rows: DataFrame, least: int = 1) -> DataFrame:
    """Alias rows (``id, canonical, name, language, ord``) by id: distinct names
    in order of appearance, the canonical name of the last row."""
    from .ranking import keep_first

    distinct = keep_first(rows, ["id", "name"], ["ord"])
    made = distinct.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("ord", "name", "language"))).alias("a"))
    last = rows.groupBy("id").agg(F.max_by("canonical", "ord").alias("canonical"))
    aliases = F.transform("a", lambda x: F.struct(x["name"].alias("name"), x["language"].alias("language")))
    return made.filter(F.size("a") >= least).join(last, "id").select(F.col("id").alias("entity_id"), "canonical", aliases.alias("aliases"))


def export_mapping(report: DataFrame, source: str) -> DataFrame:
    """Exported entities (``entity_id, records`` array of data_source and
    record_id, ``ord``) of one source by record; the last row wins."""
    rows = report.select("entity_id", "ord", F.explode("records").alias("r")).filter(F.col("r.data_source") == source)
    return rows.groupBy(F.col("r.record_id").alias("record_id")).agg(F.max_by("entity_id", F.struct("ord", "entity_id")).alias("entity_id"))
