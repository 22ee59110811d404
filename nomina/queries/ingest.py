"""Ingest, profiling, sampling and loading queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import loading, metrics, records, sampling
from ..plans import pipelines
from ..sources import readers
from .base import WITH_NAMES, Query, names, rounded, table

#: Records by the suppliers that stand for them.
_LOADED = {1: "NK-6JHQE4LmZLd9PATFPLNcMW", 2: "NK-3NULJaQxASzh2kVjbFYdcx"}


def _lines(spark, d):
    """Raw lines made of customers: one in eleven is corrupt, one in seven too
    short; most end in a comma."""
    c = table(spark, d, "customer")
    entry = F.struct(F.when(F.col("c_custkey") % 2 == 0, "PRIMARY").alias("NAME_TYPE"), F.col("c_name").alias("NAME_FULL"))
    other = F.struct(F.lit("ALIAS").alias("NAME_TYPE"), F.upper("c_name").alias("NAME_FULL"))
    names_ = F.when(F.col("c_custkey") % 3 == 0, F.array(entry, other)).otherwise(F.array(entry))
    kind = F.when(F.col("c_custkey") % 5 != 0, F.when(F.col("c_custkey") % 2 == 0, "PERSON").otherwise("organization"))
    json = F.to_json(F.struct(F.col("c_mktsegment").alias("DATA_SOURCE"), F.concat(F.lit("r"), F.col("c_custkey").cast("string")).alias("RECORD_ID"), kind.alias("RECORD_TYPE"), names_.alias("NAMES"), F.col("c_nationkey").alias("NATION")))
    line = F.when(F.col("c_custkey") % 11 == 0, F.concat(F.lit("{broken "), json)).when(F.col("c_custkey") % 7 == 0, "  {} ").otherwise(F.concat(F.lit("  "), json, F.lit(",  ")))
    return c.select("c_custkey", line.alias("value"))


def parse_lines(spark, d):
    p = _lines(spark, d).withColumn("line", readers.parse_line(F.col("value")))
    return p.agg(F.count(F.lit(1)).alias("lines"), F.count("line").alias("kept"), F.count_if(F.endswith("line", F.lit(","))).alias("commas"), F.count_if(F.endswith("value", F.lit("  "))).alias("padded"))


def _records(spark, d):
    return readers.decoded(_lines(spark, d).withColumn("value", readers.parse_line(F.col("value"))))


def tolerant_json(spark, d):
    return _records(spark, d).select("RECORD_ID", "DATA_SOURCE", records.record_type().alias("record_type"), F.size("NAMES").cast("long").alias("n_names"), F.get_json_object("raw", "$.NATION").cast("int").alias("nation"))


def names_explode(spark, d):
    return records.names(_records(spark, d)).select("record_id", "record_type", "idx", "name", "kind", "query_name_type")


def test_cases(spark, d):
    c = records.test_cases(records.names(_records(spark, d)), "2025-01-01")
    return c.select("test_case_id", "record_id", "data_source", "query_name", F.array_join("all_aliases", "|").alias("all_aliases"), F.col("metadata.original_index").alias("original_index"), F.col("metadata.sample_date").alias("sample_date"))


def record_filters(spark, d):
    r = records.of_type(_records(spark, d), "organization")
    return r.groupBy("DATA_SOURCE").agg(F.count(F.lit(1)).alias("organizations")).join(records.with_aliases(_records(spark, d)).groupBy("DATA_SOURCE").agg(F.count(F.lit(1)).alias("with_aliases")), "DATA_SOURCE", "full")


def alias_counts(spark, d):
    return _records(spark, d).groupBy(F.size("NAMES").cast("long").alias("aliases")).agg(F.count(F.lit(1)).alias("n")).orderBy("aliases").limit(10)


def _analyzed(spark, d):
    a = records.analyzed(_records(spark, d))
    return a.select("RECORD_ID", "record_type", "alias_count", "script", "complexity", "has_aliases")


def analyze_records(spark, d):
    return _analyzed(spark, d).withColumn("alias_count", F.col("alias_count").cast("long"))


def profile_counts(spark, d):
    return rounded(metrics.counted(names(spark, d).withColumn("complexity", text.complexity(F.col("name"))), "complexity"))


def entity_group_collect(spark, d):
    """Parts of a brand as an entity's aliases."""
    p = table(spark, d, "part")
    rows = p.select(F.col("p_brand").alias("id"), F.concat("p_type", F.lit("/"), F.col("p_size").cast("string")).alias("canonical"), F.col("p_name").alias("name"), F.col("p_type").alias("language"), F.col("p_partkey").alias("ord"))
    e = records.entities_from_rows(rows, least=2)
    return e.select("entity_id", "canonical", F.size("aliases").cast("long").alias("n"), F.array_join(F.transform(F.slice("aliases", 1, 3), lambda a: a["name"]), "|").alias("first"))


def loader_records(spark, d):
    p = table(spark, d, "conversations")
    a = p.groupBy(F.col("conv_id").cast("string").alias("entity_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: F.struct(x["text"].alias("name"))).alias("aliases"))
    r = records.loader_records(a)
    return r.select("DATA_SOURCE", "RECORD_ID", "RECORD_TYPE", F.size("NAMES").cast("long").alias("n"), F.get(F.col("NAMES"), F.lit(0))["NAME_ORG"].alias("first"))


def semi_manual(spark, d):
    """Hand-written cases of the records that are there."""
    ids = F.create_map(*[F.lit(x) for pair in _LOADED.items() for x in pair])
    loaded = table(spark, d, "supplier").select(F.try_element_at(ids, F.col("s_suppkey").cast("int")).alias("record_id"))
    return pipelines.manual_variants(spark, loaded)


def _cases(spark, d):
    o = table(spark, d, "customer")
    return o.select(F.col("c_mktsegment").alias("data_source"), F.concat(F.lit("r"), (F.col("c_custkey") * 2).cast("string")).alias("record_id"), F.col("c_name").alias("query_name"))


def _entities(spark, d):
    c = table(spark, d, "customer")
    return c.select(F.col("c_mktsegment").alias("data_source"), F.concat(F.lit("r"), F.col("c_custkey").cast("string")).alias("record_id"), (F.col("c_custkey") % 50).alias("entity_id"))


def id_lookup_inner(spark, d):
    return records.resolved(_cases(spark, d), _entities(spark, d)).select("data_source", "record_id", "query_name", "expected_entity_id")


def id_lookup_left(spark, d):
    return _cases(spark, d).join(_entities(spark, d), ["data_source", "record_id"], "left").select("data_source", "record_id", "entity_id")


def anti_unmatched(spark, d):
    return records.unresolved(_cases(spark, d), _entities(spark, d)).groupBy("data_source").agg(F.count(F.lit(1)).alias("unmatched"))


def ready_cases(spark, d):
    return records.ready(records.resolved(_cases(spark, d), _entities(spark, d))).groupBy("data_source").agg(F.count(F.lit(1)).alias("ready"))


def in_list_counts(spark, d):
    few = table(spark, d, "nation").filter("n_regionkey = 1").select(F.col("n_nationkey").alias("s_nationkey"))
    return table(spark, d, "supplier").join(few, "s_nationkey", "left_semi").groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("n"))


def export_mapping(spark, d):
    """Orders as an export: a customer's records, the last order wins."""
    o = table(spark, d, "lineitem")
    r = F.array(F.struct(F.col("l_returnflag").alias("data_source"), F.col("l_partkey").cast("string").alias("record_id")), F.struct(F.lit("X").alias("data_source"), F.lit("0").alias("record_id")))
    return records.export_mapping(o.select(F.col("l_orderkey").alias("entity_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"), r.alias("records")), "N")


def first_filled(spark, d):
    n = names(spark, d).select("id", F.when(F.col("record_type") == "PERSON", "").otherwise(F.col("name")).alias("variant_query"), F.lit(None).cast("string").alias("query_name"), F.col("name"))
    return n.select("id", records.first_filled("variant_query", "query_name", "name").alias("query"))


def seeded_sample(spark, d):
    return sampling.sample(table(spark, d, "documents").select("doc_id", "lang"), 100, "doc_id")


def seeded_shuffle_rank(spark, d):
    return sampling.placed(table(spark, d, "supplier").select("s_suppkey"), "s_suppkey")


def stratified_sample(spark, d):
    a = names(spark, d).select("id", "record_type", text.complexity(F.col("name")).alias("complexity"), (F.length("name") % 3 == 0).alias("has_aliases"), F.when(F.length("name") % 4 == 0, "other").otherwise("latin").alias("script"))
    return sampling.stratified(a, 120, "id", 0.4).select("id", "record_type", "has_aliases", "script")


def priority_split(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.greatest(F.col("p_size") - 45, F.lit(0)).alias("priority"))
    return sampling.priority_split(p, 60, "priority", "p_partkey")


def _attempts(spark, d):
    """Events as tries to load a user's record: errors by number of the event."""
    e = table(spark, d, "events")
    message = F.when(F.col("event_id") % 10 == 3, "operation timed out").when(F.col("event_id") % 37 == 5, "value too long for type").when(F.col("event_id") % 41 == 7, "disk failure")
    from pyspark.sql import Window

    nth = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return e.select("event_id", F.col("user_id").cast("string").alias("record_id"), nth.alias("attempt"), loading.error_type(message).alias("error_type"))


def error_tally(spark, d):
    return rounded(loading.tally(_attempts(spark, d)))


def retry_outcomes(spark, d):
    return loading.final_outcomes(_attempts(spark, d))


def dead_letters(spark, d):
    again, dead = loading.split_failures(_attempts(spark, d).filter("error_type is not null"))
    return again.agg(F.count(F.lit(1)).alias("again")).crossJoin(dead.agg(F.count(F.lit(1)).alias("dead")))


def table_counts(spark, d):
    e = table(spark, d, "embeddings")
    return loading.counts(table(spark, d, "documents"), e.filter("label % 2 = 0"), e.filter("label % 2 = 1"))


def durations(spark, d):
    return table(spark, d, "orders").select("o_orderkey", text.hhmmss(F.col("o_totalprice")).alias("hhmmss"))


def prob_or(spark, d):
    e = table(spark, d, "events")
    n, m = F.col("event_id") % 101, (F.col("event_id") * 7) % 101
    return rounded(e.select("event_id", text.probabilistic_or(n.cast("double"), m.cast("double")).alias("combined")))


def score_bucket(spark, d):
    e = table(spark, d, "events")
    n = F.when(F.col("event_id") % 13 != 0, (F.col("event_id") * 7) % 101)
    return e.select("event_id", text.bucket(n).alias("name_bucket"), text.bucket(n, "BIZNAME").alias("biz_bucket"), text.validity(n).alias("validity"))


def found_first(spark, d):
    """Wanted parts in a file of order lines: the first line of each."""
    rows = table(spark, d, "lineitem").select(F.col("l_partkey").alias("RECORD_ID"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ordinal"), F.col("l_quantity").alias("quantity"))
    wanted = table(spark, d, "part").filter("p_size = 7").select(F.col("p_partkey").alias("RECORD_ID"))
    return readers.found_first(wanted, rows)


def first_lines(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ordinal"))
    return readers.first_lines(rows, 50)


def algorithm_names(spark, d):
    s = table(spark, d, "supplier")
    path, base = F.concat(F.lit("/models/"), "s_name", F.lit("/")), F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("org/"), "s_name"))
    kind = F.when(F.col("s_suppkey") % 3 != 0, F.lit("onnx_fp16"))
    return s.select("s_suppkey", readers.algorithm_name(path, base, kind).alias("algorithm"), readers.algorithm_name(path).alias("folder"))


def timestamps(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", text.iso_utc(F.col("ts")).alias("at"), F.round(text.threshold_distance(F.col("event_id") % 100 / 100.0), 6).alias("distance"))


def set_operations(spark, d):
    """Customers with an order and suppliers, as sets of nations."""
    a = table(spark, d, "customer").filter("c_acctbal > 9000").select(F.col("c_nationkey").alias("nation"))
    b = table(spark, d, "supplier").select(F.col("s_nationkey").alias("nation"))
    tag = lambda df, op: df.select(F.lit(op).alias("op"), "nation")
    return tag(a.intersect(b), "intersect").unionByName(tag(a.subtract(b), "except")).unionByName(tag(a.union(b).distinct(), "union")).unionByName(tag(b.subtract(a), "reverse"))


# SQL.
_JSON = """json AS (SELECT c_custkey, c_name, c_mktsegment, c_nationkey,
  CASE WHEN c_custkey % 11 = 0 THEN 'corrupt' WHEN c_custkey % 7 = 0 THEN 'short' ELSE 'good' END AS state,
  CASE WHEN c_custkey % 5 <> 0 THEN CASE WHEN c_custkey % 2 = 0 THEN 'PERSON' ELSE 'ORGANIZATION' END END AS kind, CASE WHEN c_custkey % 3 = 0 THEN 2 ELSE 1 END AS n FROM customer)"""
_GOOD = f"WITH {_JSON}, rec AS (SELECT 'r' || c_custkey AS record_id, c_mktsegment AS data_source, kind, n, c_name, c_nationkey FROM json WHERE state = 'good') "
_NAMES = """, nm AS (SELECT record_id, data_source, coalesce(kind, 'PERSON') AS record_type, 0 AS idx, c_name AS name, 'primary' AS kind FROM rec
  UNION ALL SELECT record_id, data_source, coalesce(kind, 'PERSON'), 1, upper(c_name), 'alias' FROM rec WHERE n = 2) """
_CASES = """WITH cs AS (SELECT c_mktsegment AS data_source, 'r' || (c_custkey * 2) AS record_id, c_name AS query_name FROM customer),
en AS (SELECT c_mktsegment AS data_source, 'r' || c_custkey AS record_id, c_custkey % 50 AS entity_id FROM customer) """
_MD5 = "md5('42|' || {0})"
_TRIES = """WITH e AS (SELECT event_id, CAST(user_id AS VARCHAR) AS record_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS attempt,
  CASE WHEN event_id % 10 = 3 THEN 'retryable' WHEN event_id % 37 = 5 THEN 'too_long' WHEN event_id % 41 = 7 THEN 'other' END AS error_type FROM events) """


def _bucket(feature: str) -> str:
    return "CASE " + " ".join(f"WHEN n >= {low} THEN '{b}'" for b, low in zip(text.BUCKET_NAMES, text.BUCKETS[feature], strict=True)) + " END"


QUERIES = {
    "parse_lines": Query(parse_lines, f"WITH {_JSON} SELECT count(*) AS lines, count(*) FILTER (state <> 'short') AS kept, 0::BIGINT AS commas, count(*) FILTER (state = 'good') AS padded FROM json"),
    "tolerant_json": Query(tolerant_json, _GOOD + "SELECT record_id AS RECORD_ID, data_source AS DATA_SOURCE, coalesce(kind, 'UNKNOWN') AS record_type, CAST(n AS BIGINT) AS n_names, CAST(c_nationkey AS INTEGER) AS nation FROM rec"),
    "names_explode": Query(names_explode, _GOOD + _NAMES + "SELECT record_id, record_type, idx, name, kind, kind || '_Latin' AS query_name_type FROM nm"),
    "test_cases": Query(test_cases, _GOOD + _NAMES + "SELECT record_id || '_name_' || idx AS test_case_id, record_id, data_source, name AS query_name, string_agg(name, '|' ) OVER (PARTITION BY record_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS all_aliases, CAST(idx AS BIGINT) AS original_index, '2025-01-01' AS sample_date FROM nm"),
    "record_filters": Query(record_filters, _GOOD + "SELECT data_source AS DATA_SOURCE, count(*) FILTER (kind = 'ORGANIZATION') AS organizations, count(*) FILTER (n >= 2) AS with_aliases FROM rec GROUP BY 1"),
    "alias_counts": Query(alias_counts, _GOOD + "SELECT CAST(n AS BIGINT) AS aliases, count(*) AS n FROM rec GROUP BY 1 ORDER BY 1 LIMIT 10"),
    "analyze_records": Query(analyze_records, _GOOD + "SELECT record_id AS RECORD_ID, coalesce(kind, 'UNKNOWN') AS record_type, CAST(n AS BIGINT) AS alias_count, CASE WHEN len(regexp_extract_all(c_name, '[A-z]')) >= len(regexp_extract_all(c_name, '[^A-z ]')) THEN 'latin' ELSE 'other' END AS script, CASE WHEN regexp_matches(c_name, '[^A-Za-z0-9_ -]') THEN 'complex' ELSE 'simple' END AS complexity, n > 1 AS has_aliases FROM rec"),
    "entity_group_collect": Query(entity_group_collect, "WITH f AS (SELECT p_brand, p_name, min(p_partkey) AS ord FROM part GROUP BY ALL), l AS (SELECT p_brand, arg_max(p_type || '/' || p_size, p_partkey) AS canonical FROM part GROUP BY 1) SELECT p_brand AS entity_id, canonical, count(*) AS n, array_to_string((list(p_name ORDER BY ord))[1:3], '|') AS first FROM f JOIN l USING (p_brand) GROUP BY ALL HAVING count(*) >= 2"),
    "loader_records": Query(loader_records, "SELECT 'WIKIDATA' AS DATA_SOURCE, CAST(conv_id AS VARCHAR) AS RECORD_ID, 'ORGANIZATION' AS RECORD_TYPE, count(*) AS n, arg_min(text, turn) AS first FROM conversations GROUP BY conv_id"),
    "semi_manual": Query(semi_manual, """WITH m(variant_query, original_name, expected_record_id, record_type, variant_type, description) AS (VALUES
('Ryazan Refinery', 'RNPK JSC', 'NK-6JHQE4LmZLd9PATFPLNcMW', 'ORGANIZATION', 'fuzzy_company_name', 'Query missing multiple significant words'),
('Vladimir Bychkov', 'Бычков Владимир Петрович', 'NK-3NULJaQxASzh2kVjbFYdcx', 'PERSON', 'patronymic_dropped', 'Latin transliteration without patronymic'),
('Bychkov Vladimir', 'Бычков Владимир Петрович', 'NK-3NULJaQxASzh2kVjbFYdcx', 'PERSON', 'name_order_variation', 'Last name first, no patronymic'),
('Vladamir Bychkov', 'Бычков Владимир Петрович', 'NK-3NULJaQxASzh2kVjbFYdcx', 'PERSON', 'spelling_variation', 'Typo: ''Vladamir'' vs ''Vladimir'' (a instead of i)'))
SELECT *, 'OPEN_SANCTIONS' AS data_source, 'manual' AS source FROM m WHERE (SELECT count(*) FROM supplier WHERE s_suppkey IN (1, 2)) > 0"""),
    "id_lookup_inner": Query(id_lookup_inner, _CASES + "SELECT data_source, record_id, query_name, entity_id AS expected_entity_id FROM cs JOIN en USING (data_source, record_id)"),
    "id_lookup_left": Query(id_lookup_left, _CASES + "SELECT data_source, record_id, entity_id FROM cs LEFT JOIN en USING (data_source, record_id)"),
    "anti_unmatched": Query(anti_unmatched, _CASES + "SELECT data_source, count(*) AS unmatched FROM cs WHERE NOT EXISTS (SELECT 1 FROM en WHERE en.data_source = cs.data_source AND en.record_id = cs.record_id) GROUP BY 1"),
    "ready_cases": Query(ready_cases, _CASES + "SELECT data_source, count(*) AS ready FROM cs JOIN en USING (data_source, record_id) WHERE entity_id <> 0 GROUP BY 1"),
    "in_list_counts": Query(in_list_counts, "SELECT s_nationkey, count(*) AS n FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) GROUP BY 1"),
    "export_mapping": Query(export_mapping, "SELECT CAST(l_partkey AS VARCHAR) AS record_id, arg_max(l_orderkey, l_orderkey * 10 + l_linenumber) AS entity_id FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1"),
    "first_filled": Query(first_filled, f"WITH {WITH_NAMES} SELECT id, nullif(name, '') AS query FROM names"),
    "seeded_sample": Query(seeded_sample, f"SELECT doc_id, lang FROM documents ORDER BY {_MD5.format('doc_id')}, doc_id LIMIT 100"),
    "seeded_shuffle_rank": Query(seeded_shuffle_rank, f"SELECT s_suppkey, row_number() OVER (ORDER BY {_MD5.format('s_suppkey')}, s_suppkey) AS place FROM supplier"),
    "stratified_sample": Query(stratified_sample, f"""WITH {WITH_NAMES}, a AS (SELECT id, record_type, length(name) % 3 = 0 AS has_aliases, CASE WHEN length(name) % 4 = 0 THEN 'other' ELSE 'latin' END AS script, {_MD5.format('id')} AS draw, CASE WHEN record_type = 'PERSON' THEN 48 ELSE 72 END AS target FROM names),
f AS (SELECT id FROM a WHERE has_aliases QUALIFY row_number() OVER (PARTITION BY record_type ORDER BY draw, id) <= floor(target * 0.3)),
s AS (SELECT id FROM a WHERE script <> 'latin' AND id NOT IN (FROM f) QUALIFY row_number() OVER (PARTITION BY record_type ORDER BY draw, id) <= floor(target * 0.2)),
t AS (FROM f UNION ALL FROM s), g AS (SELECT record_type, count(*) AS got FROM a WHERE id IN (FROM t) GROUP BY 1),
r AS (SELECT id FROM a JOIN g USING (record_type) WHERE id NOT IN (FROM t) QUALIFY row_number() OVER (PARTITION BY record_type ORDER BY draw, id) <= target - got)
SELECT id, record_type, has_aliases, script FROM a WHERE id IN (FROM t) OR id IN (FROM r)"""),
    "priority_split": Query(priority_split, f"""WITH p AS (SELECT p_partkey, greatest(p_size - 45, 0) AS priority FROM part), a AS (SELECT * FROM p WHERE priority > 0 ORDER BY priority DESC, p_partkey LIMIT 48)
FROM a UNION ALL (SELECT * FROM p WHERE priority = 0 QUALIFY row_number() OVER (ORDER BY {_MD5.format('p_partkey')}, p_partkey) <= 60 - (SELECT count(*) FROM a))"""),
    "error_tally": Query(error_tally, _TRIES + "SELECT coalesce(error_type, 'success') AS outcome, count(*) AS n, round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM e), 6) AS percent FROM e GROUP BY 1"),
    "retry_outcomes": Query(retry_outcomes, _TRIES + ", t AS (SELECT * FROM e WHERE attempt <= 3), l AS (SELECT record_id, CAST(coalesce(min(attempt) FILTER (error_type IS DISTINCT FROM 'retryable'), max(attempt)) AS INTEGER) AS attempts FROM t GROUP BY 1) SELECT record_id, attempts, coalesce(error_type, 'success') AS outcome FROM l JOIN t USING (record_id) WHERE attempt = attempts"),
    "dead_letters": Query(dead_letters, _TRIES + "SELECT count(*) FILTER (error_type = 'retryable') AS again, count(*) FILTER (error_type <> 'retryable') AS dead FROM e"),
    "found_first": Query(found_first, "SELECT l_partkey AS RECORD_ID, min(l_orderkey * 10 + l_linenumber) AS ordinal, arg_min(l_quantity, l_orderkey * 10 + l_linenumber) AS quantity FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size = 7) GROUP BY 1"),
    "first_lines": Query(first_lines, "SELECT l_orderkey, l_linenumber, l_orderkey * 10 + l_linenumber AS ordinal FROM lineitem ORDER BY ordinal LIMIT 50"),
    "algorithm_names": Query(algorithm_names, "SELECT s_suppkey, s_name || CASE WHEN s_suppkey % 2 = 0 AND s_suppkey % 3 <> 0 THEN '-onnx_fp16' ELSE '' END AS algorithm, s_name AS folder FROM supplier"),
    "timestamps": Query(timestamps, "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS at, round(1 - event_id % 100 / 100.0::DOUBLE, 6) AS distance FROM events"),
    "set_operations": Query(set_operations, "WITH a AS (SELECT c_nationkey AS nation FROM customer WHERE c_acctbal > 9000), b AS (SELECT s_nationkey AS nation FROM supplier) SELECT 'intersect' AS op, nation FROM (FROM a INTERSECT FROM b) UNION ALL SELECT 'except', nation FROM (FROM a EXCEPT FROM b) UNION ALL SELECT 'union', nation FROM (FROM a UNION FROM b) UNION ALL SELECT 'reverse', nation FROM (FROM b EXCEPT FROM a)"),
    "table_counts": Query(table_counts, "SELECT (SELECT count(*) FROM documents) AS records, (SELECT count(*) FROM embeddings WHERE label % 2 = 0) AS business_embeddings, (SELECT count(*) FROM embeddings WHERE label % 2 = 1) AS name_embeddings"),
    "durations": Query(durations, "WITH s AS (SELECT o_orderkey, CAST(trunc(o_totalprice) AS BIGINT) AS s FROM orders) SELECT o_orderkey, lpad(CAST(s // 3600 AS VARCHAR), CAST(greatest(2, length(CAST(s // 3600 AS VARCHAR))) AS INTEGER), '0') || ':' || lpad(CAST(s // 60 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') AS hhmmss FROM s"),
    "prob_or": Query(prob_or, "SELECT event_id, round(100.0::DOUBLE * (1 - (1 - (event_id % 101) / 100.0::DOUBLE) * (1 - (event_id * 7 % 101) / 100.0::DOUBLE)), 6) AS combined FROM events"),
    "score_bucket": Query(score_bucket, f"WITH s AS (SELECT event_id, CASE WHEN event_id % 13 <> 0 THEN event_id * 7 % 101 END AS n FROM events) SELECT event_id, {_bucket('NAME')} AS name_bucket, {_bucket('BIZNAME')} AS biz_bucket, CASE WHEN n IS NULL THEN 'NO GNR' WHEN n >= 85 THEN 'PASS' ELSE 'FAIL' END AS validity FROM s"),
}
_COMPLEX = r"CASE WHEN name = '' THEN 'empty' WHEN regexp_matches(name, '[^\p{L}\p{M}\p{N}_\s-]') THEN 'complex' WHEN w <= 2 THEN 'simple' WHEN w <= 4 THEN 'medium' ELSE 'complex' END"
QUERIES["profile_counts"] = Query(profile_counts, rf"WITH {WITH_NAMES}, c AS (SELECT {_COMPLEX} AS value FROM (SELECT name, len(list_filter(string_split_regex(name, '\s+'), lambda x: x <> '')) AS w FROM names)) SELECT value, count(*) AS n, round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM c), 6) AS percent FROM c GROUP BY 1")
