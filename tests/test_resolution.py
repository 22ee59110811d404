"""Name scores against all matchings, components against union-find, resolution
batch by batch against all at once."""

import random
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from nomina.operators import alignment, components, lexical, resolution, scoring


def plain_align(rows):
    m, n = len(rows), len(rows[0])
    best = 0
    slots = [*range(n), *[None] * m]
    for chosen in set(permutations(slots, m)):
        met = [j for i, j in enumerate(chosen) if j is not None and rows[i][j] > 0]
        total = sum(rows[i][j] for i, j in enumerate(chosen) if j is not None)
        best = max(best, 2 * total // (m + n) - (0 if met == sorted(met) else scoring.TURNED))
    return best


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 4).flatmap(lambda n: st.lists(st.lists(st.sampled_from([0, 0, 60, 75, 80, 100]), min_size=n, max_size=n), min_size=1, max_size=4)))
def test_the_best_matching(rows):
    assert scoring.align(rows) == plain_align(rows)


def test_scores(spark):
    rows = [
        ("John William Smith", "John W. Smith", 93), ("Smith, John", "john smith", 95), ("Jon Smith", "John Smith", 87), ("Acme", "Nintendo", None),
        (None, "a", None), ("", "a", None), ("  ", "  ", None), ("a", "a", 100), ("Müller AG", "MÜLLER AG", 100), ("Acme Ltd.", "Acme Ltd", 100), ("a b c d e f g h i j", "j i h g f e d c b a", 95),
    ]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(rows)] * 2, "i int, name_a string, name_b string").withColumn("rows", F.lit("clash"))
    got = scoring.scored_names(df).collect()
    assert len(got) == 2 * len(rows) and {r["i"]: r["score"] for r in got} == {i: s for i, (_, _, s) in enumerate(rows)}
    turned = scoring.scored_names(df.select("i", F.col("name_b").alias("name_a"), F.col("name_a").alias("name_b"))).collect()
    assert {r["i"]: r["score"] for r in turned} == {i: s for i, (_, _, s) in enumerate(rows)}
    assert scoring.scored_names(df.limit(0)).count() == 0


def test_why(spark):
    aliases = spark.createDataFrame([(1, "Acme Trading"), (1, "Acme Trading"), (1, "ACME Trading Company"), (1, None), (2, "Nintendo"), (None, "Acme")], "entity long, name string")
    pairs = spark.createDataFrame([("Acme Trading Co", 1, "x"), ("Acme Trading Co", 1, "y"), ("Acme Trading Co", 2, "x"), (None, 1, "x"), ("Acme", None, "x"), ("Acme", 3, "x")], "name string, entity long, alias_of string")
    got = {(r["name"], r["entity"], r["alias_of"]): (r["score"], r["alias"], r["bucket"], r["agree"]) for r in scoring.why(pairs, aliases).collect()}
    assert len(got) == 6
    best = (80, "Acme Trading", "same", ["acme", "trading"])
    assert got["Acme Trading Co", 1, "x"] == got["Acme Trading Co", 1, "y"] == best
    assert all(v == (None, None, None, None) for k, v in got.items() if k[:2] != ("Acme Trading Co", 1))


def plain_roots(edges, nodes=()):
    parent = {n: n for n in nodes} | {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in edges:
        a, b = sorted((find(u), find(v)))
        parent[b] = a
    return {x: find(x) for x in parent}


def test_components(spark):
    r = random.Random(1)
    edges = [(f"n{r.randrange(300):03d}", f"n{r.randrange(300):03d}") for _ in range(200)] + [("hub", f"leaf{i}") for i in range(400)] + [(f"p{i:03d}", f"p{i + 1:03d}") for i in range(120)]
    df = spark.createDataFrame([*edges, (None, "n001"), ("n001", "n001")], "u string, v string")
    got = {x["node"]: x["root"] for x in components.components(df).collect()}
    expected = plain_roots(edges)
    linked = {x for e in edges if e[0] != e[1] for x in e}
    assert got == {n: expected[n] for n in linked}
    assert components.components(df.limit(0)).count() == 0
    with pytest.raises(RuntimeError):
        components.components(df, rounds=1)


def test_components_grow(spark):
    """Links in three parts on top of what is stored: always the components of all."""
    r = random.Random(2)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(320)]
    stored = spark.createDataFrame([(n, n) for n in range(0, 400, 3)], "node long, root long")
    seen = set(range(0, 400, 3))
    for part in range(3):
        links = edges[part::3]
        seen |= {x for u, v in links if u != v for x in (u, v)}
        stored, changed = components.merged(stored, spark.createDataFrame(links, "u long, v long"))
        stored = stored.checkpoint()
        done = [e for p in range(part + 1) for e in edges[p::3]]
        plain = plain_roots(done, seen)
        assert {x["node"]: x["root"] for x in stored.collect()} == {n: plain[n] for n in seen}
        assert all(x["into"] < x["root"] for x in changed.collect())


def people(seed, n):
    r = random.Random(seed)
    first, last = ["John", "Jane", "Maria", "Peter", "Aleksandr"], ["Smith", "Schneider", "Kowalski", "Ferrari", "Johansson"]
    rows = []
    for i in range(n):
        name = f"{r.choice(first)} {r.choice(last)} {chr(97 + r.randrange(3)) * 4}"
        if r.random() < 0.4:
            k = r.randrange(len(name))
            name = name[:k] + r.choice("aeiou") + name[k + 1 :]
        rows.append((f"r{r.randrange(10**6):06d}-{i}", name, None))
    return rows


def test_batches_give_what_all_at_once_gives(spark):
    schema = "record_id string, name string, v array<double>"
    rows = people(3, 70) + [("a1", None, None), ("z1", "", None), (None, "John Smith aaaa", None)] + [(f"hot{i}", "Same Name Everywhere", None) for i in range(40)] + [("0first", "Same Name Everywhere", None)]
    rows += [("v1", "Vector One", [1.0, 0.0]), ("v2", "Vectar One", [0.0, 1.0]), ("v3", "Vector Onne", [1.0, 0.0])]
    random.Random(4).shuffle(rows)
    entities = lambda df: {x["record_id"]: x["entity_id"] for x in df.collect()}
    rules = {"cosine": 0.5}
    whole = entities(resolution.resolve(spark.createDataFrame(rows, schema), **rules))
    assert len(whole) == len(rows) - 1 and whole["hot3"] == "0first" and whole["v3"] == "v1" and whole["v2"] == "v2" and whole["a1"] == "a1"
    assert len(set(whole.values())) < 0.6 * len(rows)
    stored = None
    for part in range(2):
        stored = resolution.resolve(spark.createDataFrame(rows[part::2], schema), stored, **rules).checkpoint()
    assert entities(stored) == whole
    again = resolution.resolve(spark.createDataFrame(rows[:20] + rows[:5], schema), stored, **rules)
    assert entities(again) == whole  # records that come again change nothing
    # A record with another name leaves its entity; what it held together may part.
    changed = [(i, "Quite Another Person", None) if i == "v1" else (i, n, v) for i, n, v in rows]
    fresh = entities(resolution.resolve(spark.createDataFrame(changed, schema), **rules))
    moved = resolution.resolve(spark.createDataFrame([("v1", "Quite Another Person", None)], schema), stored, **rules)
    assert entities(moved) == fresh and fresh["v3"] == "v3"
    gone = spark.createDataFrame([("0first",), ("nobody",)], "record_id string")
    left = entities(resolution.without(stored.filter("name = 'Same Name Everywhere' or record_id < 'r1'"), gone, **rules))
    assert "0first" not in left and left["hot5"] == "hot0"
    assert resolution.resolve(stored.limit(0)).count() == 0


@pytest.mark.parametrize("theta", [0.2, 0.5, 1.0])
def test_similar_sets_against_all_pairs(spark, monkeypatch, theta):
    monkeypatch.setattr(lexical, "BLOCK", 16)
    rng = random.Random(7)
    sets = [(f"s{i}", rng.sample([f"w{k}" for k in range(30)], rng.randint(0, 8)) + ["all"] * (i % 3 > 0), i % 4 > 0) for i in range(150)]
    df = spark.createDataFrame(sets, "node string, words array<string>, asks boolean")
    got = [(*sorted((r["x"], r["y"])), round(r["jaccard"], 9)) for r in lexical.similar_sets(df, theta).collect()]
    want = set()
    for i, (x, a, asks) in enumerate(sets):
        for y, b, other in sets[:i]:
            share = len(set(a) & set(b)) / max(1, len(set(a) | set(b)))
            if share >= theta and share > 0 and (asks or other):
                want.add((*sorted((x, y)), round(share, 9)))
    assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("theta", [0.2, 0.4, 1.0])
def test_similar_names_leave_their_task_as_results(spark, monkeypatch, theta):
    """Equal to all pairs, whatever pieces and blocks there are; what is found is
    neither joined nor shuffled again."""
    for name, n in (("PIECE", 3), ("MOST", 8), ("TOGETHER", 20)):
        monkeypatch.setattr(lexical, name, n, raising=False)
    rng = random.Random(11)
    some = [" ".join(rng.choices("abcdefghij", k=rng.randint(0, 5))) for _ in range(60)]
    rows = [(i, n) for i, n in enumerate([*some, *["a b c"] * 20, *["C  b d A"] * 9, "", " ", None])] + [(None, "a b")]
    names = spark.createDataFrame(rows, "id long, name string")
    queries = spark.createDataFrame([(f"q{i}", n) for i, n in rows if i is None or i % 3 == 0], "id string, name string")
    found = lexical.similar_names(queries, names, theta)
    words = lambda n: set((n or "").lower().split())
    want = []
    for q in queries.collect():
        for i, n in rows:
            a, b = words(q["name"]), words(n)
            if a & b and len(a & b) / len(a | b) >= theta:
                want.append((q["id"], i, len(a & b) / len(a | b)))
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in found.collect())
    plan = found._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.index("FlatMapGroups")]
    assert "Exchange" not in above and "Join" not in above
    assert lexical.similar_names(queries.limit(0), names, theta).count() == 0 == lexical.similar_names(queries, names.limit(0), theta).count()


def test_why_writes_no_pairs_of_names(spark):
    """Pairs come from the join of entities and are reduced where they are."""
    aliases = spark.createDataFrame([(1, "Acme"), (1, "Acme Bank")], "entity long, name string")
    plan = scoring.why(aliases.select("entity", F.lit("Acme").alias("name")), aliases)._jdf.queryExecution().optimizedPlan().toString()
    assert "_x" not in plan and "_y" not in plan


def plain_agreement(u, v):
    if u == v:
        return 100
    if min(len(u), len(v)) == 1 and u[0] == v[0]:
        return scoring.INITIAL
    kept = 100 * (max(len(u), len(v)) - alignment.edits(u, v)) // max(len(u), len(v))
    return kept if kept >= scoring.LEAST else 0


def test_scores_of_many_names_at_once():
    """Words of one letter, long ones, those of other alphabets; names of no word and of many."""
    r = random.Random(5)
    known = ["".join(r.choices("abcdé日", k=r.choice([1, 1, 2, 3, 5, 6, 8, 11]))) for _ in range(60)] + ["x" * 300, "x" * 280 + "y" * 20, "z" * 249 + "ab"]
    rows = [r.choices(known, k=r.randint(0, 8)) for _ in range(80)]
    names = alignment.Names(pa.array(rows[:30], pa.list_(pa.string())), pa.array(rows[30:], pa.list_(pa.string())))
    p, q = (x.ravel() for x in np.meshgrid(np.arange(80), np.arange(80)))
    memo = {(u, v): plain_agreement(u, v) for u in known for v in known}
    assert names.scores(p, q).tolist() == [scoring.align([[memo[u, v] for v in rows[b]] for u in rows[a]]) for a, b in zip(p, q)]


@pytest.mark.parametrize("theta,least", [(0.2, None), (0.4, 75)])
def test_names_are_scored_where_they_meet(spark, monkeypatch, theta, least):
    monkeypatch.setattr(lexical, "BLOCK", 16)
    names = sorted({n for _, n, _ in people(8, 120)} | {"J. Smith", "smith", "Ö Ä", "..."})
    asks = {n: i % 3 > 0 for i, n in enumerate(names)}
    df = spark.createDataFrame([*asks.items()], "node string, asks boolean")
    found = lexical.scored_sets(df.select("node", resolution.trigrams(F.col("node")).alias("words"), "asks"), theta, least)
    words = {n: [w.strip(".,") for w in n.lower().split() if w.strip(".,")] for n in names}
    grams = {n: {f"^{w}$"[i : i + 3] for w in ws for i in range(len(w))} for n, ws in words.items()}
    want = []
    for i, b in enumerate(names):
        for a in names[:i]:
            share = len(grams[a] & grams[b]) / max(1, len(grams[a] | grams[b]))
            score = scoring.align([[plain_agreement(u, v) for v in words[b]] for u in words[a]])
            if share >= theta and (asks[a] or asks[b]) and score >= (least or 0):
                want.append((a, b, score or None))
    assert len(want) > 20 and sorted(map(repr, want)) == sorted(repr(tuple(x)) for x in found.collect())
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "levenshtein" not in plan and "MapIn" not in plan  # pairs go nowhere to be scored


def test_guesses_of_sizes_stay_small(spark, monkeypatch):
    """The planner's guess of the size of what a round leaves was the product of
    the round's tables: 8,038 bits after five rounds, then four times as many."""
    monkeypatch.setattr(components, "FEW", 0)
    nodes = list(range(400))
    random.Random(6).shuffle(nodes)
    got = components.components(spark.createDataFrame([*zip(nodes, nodes[1:])], "u long, v long"))
    guess = got._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    assert {(x["node"], x["root"]) for x in got.collect()} == {(n, 0) for n in nodes}
    assert guess.bit_length() < 100


@pytest.mark.parametrize("listed", [0, 10**6])
def test_the_best_alias_of_large_entities(spark, monkeypatch, listed):
    """Equal to all pairs, in blocks or not, bounded or listed; words are compared
    as words of a block, not pair by pair."""
    monkeypatch.setattr(scoring, "MOST", 16, raising=False)
    monkeypatch.setattr(scoring, "LISTED", listed, raising=False)
    known = [(i % 3, n) for i, (_, n, _) in enumerate(people(9, 90))] + [(1, "J. Smith"), (1, "..."), (7, "Alone")]
    asked = [(n, (e + 1) % 3) for e, n in known] + [("Smith John", 0), ("x", 1)]
    found = scoring.why(spark.createDataFrame(asked, "name string, entity long"), spark.createDataFrame(known, "entity long, name string"))
    words = lambda n: [w.strip(".,") for w in n.lower().split() if w.strip(".,")]
    score = lambda a, b: scoring.align([[plain_agreement(u, v) for v in words(b)] for u in words(a)])
    want = []
    for name, entity in asked:
        s, alias = min((-score(name, n), n) for e, n in known if e == entity)
        want.append((name, entity, -s or None, alias if s else None))
    assert sorted(map(repr, want)) == sorted(repr(tuple(x)) for x in found.select("name", "entity", "score", "alias").collect())
    assert "MapIn" not in found._jdf.queryExecution().optimizedPlan().toString()
