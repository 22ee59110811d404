"""The registered queries on the smallest tables, against their SQL."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from nomina.llm import queries

DIR = "/root/testdata/sf0.001"
SQL = queries.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(DIR).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([float(f"{r[i]:.9g}") if isinstance(r[i], float) else r[i] for i in order]) for r in found)


@pytest.mark.parametrize("name", list(queries.queries()))
def test_query(spark, duck, name):
    df = queries.queries()[name](spark, DIR)
    found = df.collect()
    assert found
    if name in SQL:
        cur = duck.execute(SQL[name])
        columns = [c[0] for c in cur.description]
        assert sorted(columns) == sorted(df.columns)
        assert rows(df.columns, found) == rows(columns, cur.fetchall())
    elif name != "op6_packing":
        assert len(found) == spark.read.parquet(f"{DIR}/documents.parquet").count()


def _duck(folder):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet')")
    return con


WORDS = r"'[^\x20\x09-\x0D]+'"


def test_base_counts_of_personal_data_in_sql(spark):
    folder = "/root/testdata/sf0.01"
    sql = r"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    m AS (
      SELECT doc_id, len(regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+')) AS n_email,
        len(list_filter(regexp_extract_all(t, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)'), lambda x: len(list_filter(string_split(x, '.'), lambda p: CAST(p AS HUGEINT) > 255)) = 0)) AS n_ip,
        list_transform(regexp_extract_all(t, '[0-9]([\x20-]?[0-9])+'), lambda x: regexp_replace(x, '[^0-9]', '', 'g')) AS cards,
        len(list_filter(regexp_extract_all(t, '\+[0-9][\x20().0-9-]+[0-9]'), lambda x: length(regexp_replace(x, '[^0-9]', '', 'g')) BETWEEN 9 AND 15)) AS n_phone
      FROM d)
    SELECT doc_id, n_email, n_ip, len(list_filter(cards, lambda c: length(c) BETWEEN 12 AND 19 AND list_sum(list_transform(range(1, length(c) + 1),
      lambda i: CASE WHEN (length(c) - i) % 2 = 1 THEN (2 * CAST(c[i] AS INTEGER)) // 10 + (2 * CAST(c[i] AS INTEGER)) % 10 ELSE CAST(c[i] AS INTEGER) END)) % 10 = 0)) AS n_card, n_phone FROM m
    """
    found = queries.op3_pii(spark, folder).select("doc_id", "n_email", "n_ip", "n_card", "n_phone").collect()
    expected = _duck(folder).execute(sql).fetchall()
    assert sorted(map(tuple, found)) == sorted(expected) and all(sum(r[k] for r in expected) for k in range(1, 5))


def test_rule_counts_in_sql(spark):
    folder = "/root/testdata/sf0.01"
    sql = rf"""
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents), w AS (SELECT *, regexp_extract_all(t, {WORDS}) AS ws FROM d),
    l AS (SELECT rid, count(*) - count(DISTINCT line) AS dup FROM (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, {WORDS}) GROUP BY rid),
    x AS (SELECT rid, i, ws[i : i + 2] AS win FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) > 2)),
    often AS (SELECT rid, i FROM x QUALIFY count(*) OVER (PARTITION BY rid, win) > 1),
    r AS (SELECT rid, count(DISTINCT i + k) AS n FROM often, (VALUES (0), (1), (2)) v(k) GROUP BY rid)
    SELECT doc_id, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, coalesce(dup, 0), coalesce(n, 0),
      len(ws) < 50 OR 100 * coalesce(n, 0) > 50 * len(ws) FROM w LEFT JOIN l USING (rid) LEFT JOIN r USING (rid)
    """
    found = queries.op4_quality_rules(spark, folder).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()
    expected = _duck(folder).execute(sql).fetchall()
    assert sorted(tuple(r)[:-1] for r in found) == sorted(expected)
    assert not any(r["kept"] and r["base_failed"] for r in found)


def test_components_in_sql(spark):
    folder = "/root/testdata/sf0.01"
    found = queries.op8_simhash(spark, folder).toPandas()
    con = duckdb.connect()
    con.register("found", found)
    sql = """
    WITH RECURSIVE f AS (SELECT fingerprint AS p, CAST('0x' || fingerprint AS UBIGINT) AS x, min(doc_id) AS least FROM found GROUP BY 1),
    e AS (SELECT a.p AS u, b.p AS v FROM f a JOIN f b ON bit_count(xor(a.x, b.x)) <= 4),
    r AS (SELECT u, v FROM e UNION SELECT r.u, e.v FROM r JOIN e ON r.v = e.u)
    SELECT d.doc_id, min(f.least) FROM found d JOIN r ON d.fingerprint = r.u JOIN f ON f.p = r.v GROUP BY ALL
    """
    assert sorted(con.execute(sql).fetchall()) == sorted(zip(found["doc_id"].tolist(), found["component_id"].tolist()))


def test_fingerprints_are_printed_whole(spark):
    found = queries.op8_simhash(spark, DIR).collect()
    assert all(len(r["fingerprint"]) == 16 and set(r["fingerprint"]) <= set("0123456789abcdef") for r in found)


def test_registered():
    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14))
