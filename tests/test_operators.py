"""Operators on hand-made rows, and properties that must hold."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from nomina.functions import vectors
from nomina.operators import comparison, lexical, loading, metrics, pairs, ranking, records, sampling, search, stats
from nomina.plans import pipelines


def hits(spark, cases):
    rows = [(c, "emb", i, e, 50 - i, None) for c, ids in cases.items() for i, e in enumerate(ids)]
    return spark.createDataFrame(rows, "case_id int, mode string, ordinal int, entity_id bigint, gnr_score int, emb_score int")


def test_scenarios(spark):
    h = hits(spark, {1: [7, 9], 2: [9, 7], 3: [7], 4: [9]})
    expected = spark.createDataFrame([(c, 7) for c in (1, 2, 3, 4)], "case_id int, expected_entity_id bigint")
    placed = ranking.placed(ranking.ranked(h, "ordinal"), expected)
    found = {r["case_id"]: r["s"] for r in placed.select("case_id", ranking.scenario(F.col("positive_rank"), F.col("negative_rank")).alias("s")).collect()}
    assert found == {1: "both_found_correct_order", 2: "both_found_wrong_order", 3: "only_positive_found", 4: "only_negative_found"}


def test_mrr_and_ndcg(spark):
    row = spark.createDataFrame([(1, 1), (2, 3), (None, None), (4, 7)], "a int, b int").agg(metrics.mrr_found("a").alias("f"), metrics.mrr_all("a").alias("all_"), metrics.ndcg_at("b", 5).alias("n")).first()
    assert (round(row["f"], 6), row["all_"], row["n"]) == (0.583333, 0.4375, 0.375)


def test_percentiles(spark):
    rows = spark.createDataFrame([(x,) for x in (1, 2, 3, 4)], "v int")
    assert metrics.percentiles(rows, "v", (0.5,)).first()["p50"] == 2.5
    assert tuple(metrics.floor_percentiles(rows, "v", (0.5, 0.95)).first()) == (3, 4)


def test_auc(spark):
    rows = spark.createDataFrame([(1, 0.9), (0, 0.9), (1, 0.8), (0, 0.1)], "y int, s double")
    assert stats.roc_auc(rows, "s", "y").first()["auc"] == 0.625
    assert stats.roc_auc(rows.filter("y = 1"), "s", "y").first()["auc"] == 0.5
    assert stats.roc_auc(rows.withColumn("s", 1 - F.col("s")), "s", "y").first()["auc"] == 0.375


def test_correlations(spark):
    rows = spark.createDataFrame([(1, 0.1), (2, 0.4), (3, 0.2), (4, 0.9), (None, 0.5)], "gnr_score int, cosine_sim double")
    assert round(stats.spearman(rows).first()["spearman"], 6) == 0.8
    assert round(stats.kendall(rows).first()["kendall"], 6) == 0.666667
    constant = rows.withColumn("cosine_sim", F.lit(0.5))
    assert stats.pearson(constant).first()["pearson"] == 0.0


def plain_kendall(rows):
    n, s, x, y = len(rows), 0, 0, 0
    for i in range(n):
        for j in range(i):
            a, b = np.sign(rows[i][0] - rows[j][0]), np.sign(rows[i][1] - rows[j][1])
            s, x, y = s + a * b, x + (a != 0), y + (b != 0)
    return s / math.sqrt(x * y)


@pytest.mark.parametrize("cell", [50_000, 40, 7])
def test_kendall_counts_every_pair_once(spark, cell):
    """Heavy ties in both scores, and ranges of every size."""
    r = np.random.default_rng(8)
    rows = [(int(r.integers(0, 25)) if i % 3 else 7, float(r.integers(0, 40)) / 40 if i % 4 else 0.25) for i in range(300)]
    df = spark.createDataFrame(rows, "gnr_score int, cosine_sim double")
    found = stats.kendall(df, cell=cell)
    assert round(found.first()["kendall"], 9) == round(plain_kendall(rows), 9)
    assert "Cartesian" not in found._jdf.queryExecution().executedPlan().toString()
    assert 0 <= found.first()["p_value"] <= 1


def test_p_values():
    """Against the t distribution's density, summed finely."""
    for value, n in ((0.3, 12), (-0.71, 9), (0.02, 500), (0.95, 5)):
        v = n - 2
        t = abs(value) * math.sqrt(v / (1 - value**2))
        x = np.linspace(0, t, 400_001)
        density = np.exp(math.lgamma((v + 1) / 2) - math.lgamma(v / 2)) / math.sqrt(v * math.pi) * (1 + x**2 / v) ** (-(v + 1) / 2)
        assert abs(stats._beta_tail(1 - value**2, v / 2, 0.5) - (1 - 2 * np.trapezoid(density, x))) < 1e-8
    assert stats._beta_tail(0.0, 4, 0.5) == 0.0 and stats._beta_tail(1.0, 4, 0.5) == 1.0


def test_positions_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(metrics, "RANGE", 10)
    r = np.random.default_rng(9)
    rows = [(["a", "b", None][int(r.integers(3))], float(r.integers(0, 90)) if i % 5 else 3.0) for i in range(600)] + [("a", None), ("c", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    for x in metrics.positions(df, "v", ["g"]).collect():
        own = [v for g, v in rows if g == x["g"] and v is not None]
        assert (x["n"], x["before"]) == (own.count(x["value"]), sum(v < x["value"] for v in own))
    found = {x["g"]: (x["p25"], x["p95"]) for x in metrics.percentiles(df, "v", (0.25, 0.95), ["g"]).collect()}
    for g in ("a", "b", None):
        own = [v for k, v in rows if k == g and v is not None]
        assert found[g] == pytest.approx(tuple(np.percentile(own, [25, 95])))
    assert found["c"] == (None, None)
    ranks = {(x["g"], x["v"]): x["r"] for x in stats.ranked(df.filter("v is not null"), "v", "r").collect()}
    whole = sorted(v for _, v in rows if v is not None)
    assert all(x == whole.index(v) + (whole.count(v) + 1) / 2 for (_, v), x in ranks.items())


def test_sweeps_count_scores_first(spark):
    rows = [(i, i % 3 == 0, i % 101) for i in range(500)]
    hits_ = spark.createDataFrame(rows, "case_id int, is_expected boolean, score int")
    for x in metrics.sweep_prod(hits_).collect():
        assert (x["tp"], x["fp"]) == (sum(e and s >= x["threshold"] for _, e, s in rows), sum(not e and s >= x["threshold"] for _, e, s in rows))


@pytest.mark.parametrize("n", [1, 3, 7])
def test_every_pair_gets_its_negatives(spark, n):
    """One entity holds most of the pool; names repeat; a pool may be too small."""
    pool = [(1, f"a{i % 60}") for i in range(90)] + [(e, f"e{e}-{k}") for e in range(2, 6) for k in range(2)] + [(None, "x"), (6, None)]
    rows = [(e, f"key{e}-{k}") for e in (1, 2, 5, 77) for k in range(4)]
    pool_, rows_ = spark.createDataFrame(pool, "entity int, name string"), spark.createDataFrame(rows, "entity int, key string")
    found = pairs.draw_others(rows_, ["entity", "key"], pool_, "entity", "name", n, 42).collect()
    names = {(e, m) for e, m in pool if e is not None and m is not None}
    for e, key in rows:
        own = [x["negative"] for x in found if x["key"] == key]
        others = {m for k, m in names if k != e}
        assert len(own) == len(set(own)) == min(n, len(others)) and set(own) <= others
    assert pairs.draw_others(rows_, ["key"], pool_.filter("entity = 1"), "entity", "name", 2, 42).filter("entity = 1").count() == 0


def test_numbers_are_dense_and_entities_neighbours(spark):
    pool = [(e % 7 if e % 2 else 3, f"n{e}", "xy"[e % 2]) for e in range(400)]
    rows, entities = pairs.numbered(spark.createDataFrame(pool, "e int, m string, t string"), "e", "m", ["t"])
    rows = rows.collect()
    for t in "xy":
        assert sorted(x["place"] for x in rows if x["t"] == t) == list(range(200))
    for x in entities.collect():
        own = sorted(y["place"] for y in rows if y["t"] == x["t"] and y["entity"] == x["entity"])
        assert own == list(range(x["first"], x["first"] + x["own"])) and x["total"] == 200


def plain_stratified(rows, size, ratio):
    draw = lambda r: (hashlib.md5(f"42|{r[0]}".encode()).hexdigest(), r[0])
    kinds = {k: sorted((r for r in rows if r[1] == k), key=draw) for k in ("PERSON", "ORGANIZATION")}
    p = int(size * ratio)
    o = size - p
    if len(kinds["PERSON"]) < p:
        p, o = len(kinds["PERSON"]), min(size - len(kinds["PERSON"]), len(kinds["ORGANIZATION"]))
    elif len(kinds["ORGANIZATION"]) < o:
        o = len(kinds["ORGANIZATION"])
        p = min(size - o, len(kinds["PERSON"]))
    out = set()
    for k, target in (("PERSON", p), ("ORGANIZATION", o)):
        first = [r for r in kinds[k] if r[2]][: int(target * 0.3)]
        second = [r for r in kinds[k] if r not in first and r[3] != "latin"][: int(target * 0.2)]
        rest = [r for r in kinds[k] if r not in first + second]
        out |= {r[0] for r in first + second + rest[: target - len(first) - len(second)]}
    return out


@pytest.mark.parametrize("size, ratio", [(40, 0.5), (120, 0.9), (400, 0.3), (7, 0.5)])
def test_stratified_draws_by_quota(spark, size, ratio):
    rows = [(i, "PERSON" if i % 4 == 0 else "ORGANIZATION", i % 5 == 0, "latin" if i % 3 else "other") for i in range(200)]
    df = spark.createDataFrame(rows, "id int, record_type string, has_aliases boolean, script string")
    found = sampling.stratified(df, size, "id", ratio)
    assert found.columns == df.columns and {r["id"] for r in found.collect()} == plain_stratified(rows, size, ratio)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_recall_at_the_defaults(spark):
    """Unit vectors of the small table, which have no clusters to speak of."""
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("entity"), F.col("embedding").cast("array<double>").alias("v"))
    asked = rows.filter("id % 20 = 0")
    assert search.recall(search.approximate(asked, rows, 10), search.neighbours(asked, rows, 10)).first()["recall"] >= 0.9


def test_name_overlap(spark):
    a = spark.createDataFrame([(1, 1, "x"), (1, 2, "y"), (1, 11, "z"), (2, 1, "x"), (1, 3, None)], "query_id int, rank int, name string")
    b = spark.createDataFrame([(1, 1, "y"), (1, 2, "z"), (1, 3, "x"), (3, 1, "x"), (1, 4, None)], "query_id int, rank int, name string")
    assert sorted(map(tuple, ranking.name_overlap(a, b).collect())) == [(1, 2, 20.0, "x,y"), (2, 0, 0.0, ""), (3, 0, 0.0, "")]


def test_recommendation_ties(spark):
    sweep = spark.createDataFrame([(50, 80.0, 70.0, 75.0), (60, 70.0, 80.0, 75.0)], "threshold int, recall double, precision double, f1 double")
    found = {r["profile"]: r["close"] for r in metrics.recommend_prod(sweep).collect()}
    assert found == {"balanced": 50, "conservative": 60, "aggressive": 50}


def test_metrics_are_consistent(spark):
    rows = spark.createDataFrame([(i, None if i % 3 == 0 else 1 + i % 40) for i in range(200)], "case_id int, r int")
    found = rows.agg(*[metrics.recall_at("r", k).alias(f"r{k}") for k in metrics.KS], *[metrics.ndcg_at("r", k).alias(f"n{k}") for k in metrics.KS]).first()
    recalls = [found[f"r{k}"] for k in metrics.KS]
    assert recalls == sorted(recalls)
    assert all(100 * found[f"n{k}"] <= found[f"r{k}"] + 1e-9 for k in metrics.KS)


def test_empty_results(spark):
    empty = spark.createDataFrame([], "case_id int, name_rank int, emb_rank int, record_type string, query_name_type string")
    assert metrics.rescue(empty).first()["rescue_rate"] is None
    assert metrics.breakdown(empty).count() == 0


@pytest.mark.parametrize("limit", [search.BROADCAST, 0])
def test_neighbours(spark, limit, monkeypatch):
    monkeypatch.setattr(search, "BROADCAST", limit)
    rows = [(i, i % 3, [math.cos(i), math.sin(i)]) for i in range(60)] + [(99, 0, None)]
    t = spark.createDataFrame(rows, "id bigint, entity bigint, v array<double>")
    found = search.neighbours(t.filter("id < 20"), t, k=3, least=0.5, other_entity=True, block=16).collect()
    got = {}
    for r in found:
        got.setdefault(r["query_id"], []).append((r["rank"], r["feat_id"]))
    for q in range(20):
        best = sorted(((-math.cos(q - i), i) for i in range(60) if i % 3 != q % 3 and math.cos(q - i) >= 0.5))[:3]
        assert sorted(got.get(q, [])) == [(n + 1, i) for n, (_, i) in enumerate(best)]


@pytest.mark.parametrize("block", [16_384, 20])
def test_approximate_search(spark, block):
    rows = [(i, i % 3, [math.cos(i), math.sin(i)]) for i in range(300)] + [(999, 0, None)]
    t = spark.createDataFrame(rows, "id bigint, entity bigint, v array<double>")
    q = t.filter("id < 40")
    exact = search.neighbours(q, t, k=5)
    assert search.recall(search.approximate(q, t, 5, cells=6, probes=6, block=block), exact).first()["recall"] == 1.0
    assert search.recall(search.approximate(q, t, 5, cells=6, probes=2, block=block), exact).first()["recall"] > 0.9


def test_triplets_equal_the_naive_join(spark):
    rows = [(f"a{i % 6}", f"b{i}", i % 4, i % 5, i % 2 == 0, "x", (i * 37) % 101, ((i * 53) % 100) / 100) for i in range(120)]
    p = spark.createDataFrame(rows, "name_a string, name_b string, entity_a int, entity_b int, same_entity boolean, pair_type string, gnr_score int, cosine_sim double")
    got = {(r["anchor"], r["positive"], r["negative"]) for r in pairs.triplets(p).collect()}
    both = rows + [(r[1], r[0], r[3], r[2], *r[4:]) for r in rows]
    naive = set()
    for anchor in {r[0] for r in both}:
        pos = sorted((-r[6], r[1]) for r in both if r[0] == anchor and r[4] and r[6] >= 85)
        neg = sorted((-r[7], r[1]) for r in both if r[0] == anchor and not r[4] and r[6] < 50 and r[7] >= 0.5)
        naive |= set([(anchor, b, c) for _, b in pos for _, c in neg][:5])
    assert got == naive


def test_dedupe_is_idempotent(spark):
    rows = spark.createDataFrame([("a", "b", True, 1), ("b", "a", True, 2), ("a", "b", False, 3)], "name_a string, name_b string, same_entity boolean, ord int")
    once = pairs.deduplicated(rows, "ord")
    assert [r["ord"] for r in once.orderBy("ord").collect()] == [1, 3]
    assert pairs.deduplicated(once, "ord").count() == 2


def test_stratified_quotas(spark):
    rows = [(f"k{i}", "PERSON" if i % 4 else "ORGANIZATION", i % 2 == 0, "latin" if i % 3 else "cjk") for i in range(200)]
    a = spark.createDataFrame(rows, "key string, record_type string, has_aliases boolean, script string")
    s = sampling.stratified(a, 60, "key", 0.5)
    assert {r["record_type"]: r["n"] for r in s.groupBy("record_type").agg(F.count("*").alias("n")).collect()} == {"PERSON": 30, "ORGANIZATION": 30}
    few = sampling.stratified(a, 120, "key", 0.5)
    assert few.count() == 120 and few.filter("record_type = 'ORGANIZATION'").count() == 50
    assert {r["key"] for r in s.collect()} == {r["key"] for r in sampling.stratified(a.repartition(7), 60, "key", 0.5).collect()}


def test_retry(spark):
    rows = spark.createDataFrame([("a", 1, "retryable"), ("a", 2, None), ("b", 1, "too_long"), ("b", 2, None), ("c", 1, "retryable"), ("c", 2, "retryable"), ("c", 3, "retryable"), ("c", 4, None)], "record_id string, attempt int, error_type string")
    assert {tuple(r) for r in loading.final_outcomes(rows).collect()} == {("a", 2, "success"), ("b", 1, "too_long"), ("c", 3, "retryable")}
    kinds = spark.createDataFrame([("Value too long",), ("SENZ1001 x",), ("operation timed out",), ("boom",), (None,)], "m string").select(loading.error_type(F.col("m")).alias("k"))
    assert [r["k"] for r in kinds.collect()] == ["too_long", "too_long", "retryable", "other", None]


def test_records(spark):
    rows = [("S", "r1", "organization", [("PRIMARY", None, "Acme"), ("ALIAS", None, "  "), (None, None, "Акме")]), ("S", "r2", None, [(None, "John", None)])]
    r = spark.createDataFrame(rows, records.RECORD)
    named = records.names(r)
    assert [(x["record_id"], x["idx"], x["name"], x["query_name_type"]) for x in named.orderBy("record_id", "idx").collect()] == [("r1", 0, "Acme", "primary_Latin"), ("r1", 1, "Акме", "alias_Cyrillic"), ("r2", 0, "John", "primary_Latin")]
    cases = records.test_cases(named, "2025-01-01").orderBy("test_case_id").collect()
    assert cases[0]["all_aliases"] == ["Acme", "Акме"] and cases[1]["test_case_id"] == "r1_name_1"
    made = pipelines.variants(records.test_cases(named, "x"))
    assert made.filter("variant_query = original_name").count() == 0
    enriched = pipelines.enrich(r, vectors.hash_encoder(32)).orderBy("record_id").collect()
    assert enriched[0]["name_embeddings"] is None and len(enriched[0]["bizname_embeddings"]) == 2


def test_manual_variants(spark):
    cases = spark.createDataFrame([("t1", "Custody Bank of Japan, Ltd.", "NK-39MNPnyuTJTsWuf4Prniyc", "S", "ORGANIZATION")], "test_case_id string, query_name string, record_id string, data_source string, record_type string")
    assert pipelines.manual_variants(spark).count() == 6
    found = {(r["variant_query"], r["source"]) for r in pipelines.all_variants(cases).collect()}
    assert ("Custody Bank Japan", "manual") in found and ("Custody Bank of Japan,", "automated") in found


def test_align(spark):
    rows = [(i, i // 2, i % 2, f"name {i}", "LATIN" if i % 2 else "CJK", [1.0, 0.1 * i]) for i in range(6)]
    a = spark.createDataFrame(rows, "id bigint, entity bigint, ord int, name string, script string, v array<double>")
    unit = a.withColumn("v", vectors.l2_normalize(F.col("v")))
    out = pipelines.align(unit, unit.select("name", "v"), unit.select(F.col("entity").alias("entity_b")))
    kinds = {r["pair_type"]: r["count"] for r in out.groupBy("pair_type").count().collect()}
    assert kinds["within_entity_cross_script"] == 3 and kinds["cross_entity_embedding_match"] > 0


def test_comparison(spark):
    row = spark.range(1).select(comparison.model_name(F.lit("/a/b/")).alias("n"), comparison.model_id(F.lit(""), F.lit("/x/run/model")).alias("i")).first()
    assert tuple(row) == ("b", "run")


def test_siblings_by_membership(spark):
    """As by lists of siblings, which nothing makes."""
    r = np.random.default_rng(5)
    members = spark.createDataFrame([(i, int(e), f"n{i}") for i, e in enumerate(r.integers(9, size=60))] + [(60, 99, "n60")], "id int, entity int, label string")
    cases = members.filter("id % 3 = 0").select(F.col("id").alias("case_id"), "entity")
    rows = [(c, k, f"n{j}", round(float(r.random()), 3)) for c in range(0, 61, 3) for k, j in enumerate(r.permutation(61)[:20])]
    top = spark.createDataFrame(rows + [(0, 99, rows[0][2], 9.0)], "case_id int, rank int, label string, distance double")
    lists = cases.join(members, "entity").filter("id <> case_id").groupBy("case_id").agg(F.collect_list("label").alias("aliases"))
    same = lambda a, b: sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert same(metrics.sibling_shares(cases, members, top), metrics.sibling_recall(lists, top))
    assert same(metrics.sibling_hits(cases, members, top), metrics.intra_distances(lists, top))


def test_searched_entities_without_pairs(spark):
    """As by all pairs of a query and an alias, of which ``k`` keeps every one."""
    r = np.random.default_rng(6)
    words = ["acme", "bank", "of", "west", "trade", "co"]
    rows = [(i, int(r.integers(5)), " ".join(r.choice(words, int(r.integers(1, 4)), replace=False)), r.normal(size=6).tolist()) for i in range(80)]
    rows += [(80, 7, "lonely", None), (81, None, "acme bank", [1.0] * 6), (82, 8, None, [0.5] * 6), (83, None, "bank", [1.0] * 6), (84, 9, "", [0.1] * 6)]
    a = spark.createDataFrame(rows, "id bigint, entity bigint, name string, v array<double>")
    same = lambda k: sorted(map(repr, lexical.search_modes(a, a, 0.3, 0.2, k).select("case_id", "mode", "entity_id", "gnr_score", "emb_score", "ordinal").collect()))
    assert same(None) == same(10_000)
