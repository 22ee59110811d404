"""Search, mixing, packing, sharding and the pipeline."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from nomina.llm import mixing, packing, queries, sharding, topk


def plain_top(rows, every, k):
    usable = [(i, np.floor(64 * np.array(x, float)).astype(int)) for i, x in rows if i is not None and x and all(c is not None and np.isfinite(c) for c in x)]
    out = []
    for a, (q, v) in enumerate(usable):
        if q % every == 0:
            best = sorted((-int(v @ x), i) for b, (i, x) in enumerate(usable) if a != b and len(x) == len(v))[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("block, queries_, cells, axes", [(4096, 4096, None, 16), (37, 5, 7, 3), (50, 40, 1, 0)])
def test_top_k(spark, block, queries_, cells, axes):
    r = np.random.default_rng(4)
    rows = [(i, r.normal(size=16).round(2).tolist()) for i in range(300)]
    rows += [(300 + i, rows[7][1]) for i in range(30)] + [(400, [0.0] * 16), (420, [1e6] + [-3e5] * 15)]
    # Repeated ids with other and with the same components, of queries and of others.
    rows += [(20, rows[21][1]), (20, rows[20][1]), (20, rows[20][1]), (31, rows[32][1]), (31, rows[31][1])] + [(33, rows[33][1])] * 9
    rows += [(None, rows[0][1]), (1000, None), (1020, [float("nan")] * 16), (1040, [None] * 16), (1060, []), (1080, [1.0, 2.0]), (1081, [0.5, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit("clash") for c in ("score", "v", "n", "place", "cell", "rank", "query_id")})
    got = topk.top_k(df, every=20, k=5, block=block, queries=queries_, cells=cells, axes=axes)
    assert sorted(map(tuple, got.collect())) == plain_top(rows, 20, 5)
    assert topk.top_k(df.limit(0)).count() == 0


def test_large_components_are_refused(spark):
    rows = spark.createDataFrame([(0, [1e18, 1.0]), (1, [1e18, 1.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="64 bits"):
        topk.top_k(rows).collect()
    big = [(20 * i, [2e6 * (1 + i / 7), 1.0, -3.0 * i]) for i in range(6)]  # products beyond 2 ** 53
    got = topk.top_k(spark.createDataFrame(big, "vec_id long, embedding array<double>"), k=3)
    assert sorted(map(tuple, got.collect())) == plain_top(big, 20, 3)


def clustered(n, clusters, dim, spread, seed=5):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(clusters, dim))
    return np.floor(64 * (centres[r.integers(clusters, size=n)] + spread * r.normal(size=(n, dim)))).astype(np.int64)


def test_the_bound_stops_searches():
    """Where few axes carry most of the weight, within one cell."""
    r = np.random.default_rng(6)
    x = np.floor(640 * r.normal(size=(4000, 32)) * 0.4 ** np.arange(32)).astype(np.int64)
    space = topk.fit(x.astype(float), 1, 16)
    lists = topk.Lists(np.arange(len(x)), x, np.ones(len(x), int), space.centres[0], space.axes)
    asked = np.arange(0, 4000, 50)
    found = lists.search(asked, x[asked], np.full(len(asked), topk._NONE), 20)
    for i, (rows, scores, _) in zip(asked, found):
        made = x @ x[i]
        best = [j for j in np.lexsort((np.arange(len(x)), -made)) if j != i][:20]
        assert rows.tolist() == best and scores.tolist() == made[best].tolist()
    assert lists.scored < 0.45 * len(asked) * len(x)


def test_floors_rule_out_whole_cells():
    x = clustered(4000, 12, 32, 0.1)
    space = topk.fit(x.astype(float), 12, 16)
    cell = space.cells(x.astype(float))
    scored = asked = 0
    for i in range(0, 4000, 50):
        made = x @ x[i]
        floor = np.sort(np.delete(made, i))[-20]
        for c in np.unique(cell):
            mine = np.flatnonzero(cell == c)
            lists = topk.Lists(mine, x[mine], np.ones(len(mine), int), space.centres[c], space.axes)
            ((rows, _, _),) = lists.search(np.array([i]), x[i : i + 1], np.array([floor]), 20)
            assert set(mine[rows]) >= {j for j in mine if made[j] > floor and j != i}
            scored += lists.scored
        asked += len(x)
    assert scored < 0.15 * asked


def plain_targets(sizes, weights=(5, 2, 1), most=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, fixed, open_ = sum(sizes.values()), {}, set(order)
    while open_:
        left = total - sum(fixed.values())
        share = left / sum(w[s] for s in open_)
        over = {s for s in open_ if share * w[s] > most * sizes[s]}
        if not over:
            return fixed | {s: share * w[s] for s in open_}
        fixed |= {s: most * sizes[s] for s in over}
        open_ -= over
    return fixed


def test_mixing(spark, make_docs, prose, edges):
    r = random.Random(6)
    rows = [(100 + i, prose(i, r.randrange(1, 60)), "en", r.choice(["a", "a", "a", "b", "c", "d", None, ""])) for i in range(400)]
    rows += [(i, t, "en", "e") for i, t in edges]
    docs = make_docs(rows)
    labels = spark.createDataFrame([(100 + i, i % 2) for i in range(0, 400, 3)] + [(None, 1)], "doc_id long, quality int")
    mixed = mixing.mix(mixing.quality_weights(docs, labels)).collect()
    assert len(mixed) == len(rows)
    sizes, taken = Counter(), Counter()
    by_id = {}
    for i, t, _, s in rows:
        sizes[s] += len((t or "").encode().split())
        by_id[i] = s
    targets = plain_targets(sizes)
    for m in mixed:
        s = by_id[m["doc_id"]]
        taken[s] += m["taken"]
        assert 0 <= m["taken"] <= 3 * m["size"] and m["source_size"] == sizes[s]
        assert m["target"] == pytest.approx(targets[s])
    assert {s: taken[s] for s in sizes} == {s: int(targets[s] + 1e-9) for s in sizes}
    again = mixing.mix(mixing.quality_weights(docs.repartition(5), labels)).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, mixed))
    # Copies: every row as often as the mix takes it, cut after the last word.
    docs = docs.withColumns({c: F.lit("clash") for c in ("taken", "taken_", "row", "weight", "u")})
    copied = mixing.copies(docs, mixing.mix(mixing.quality_weights(docs, labels)))
    assert copied.columns == docs.columns
    words = Counter()
    for c in copied.collect():
        words[(c["doc_id"], c["source"])] += len(c["text"].encode().split())
        assert c["taken"] == "clash" and any((c["doc_id"], c["source"]) == (i, s) and t and t.startswith(c["text"]) for i, t, _, s in rows)
    expected = Counter()
    for m in mixed:
        expected[(m["doc_id"], by_id[m["doc_id"]])] += m["taken"]
    assert all(abs(words[k] - n) <= 1 for k, n in expected.items())
    assert mixing.mix(mixing.quality_weights(make_docs([]), labels)).count() == 0


def test_copies_of_rows_without_an_id(spark, make_docs):
    rows = [(None, "a b c d e f g h i j", "en", "a"), (None, "k l m n o p q r s t", "en", "b"), (None, "u v w x", "en", "b"), (None, "u v w x", "en", "b"), (None, None, "en", "a"), (1, "k l m n", "en", None)]
    docs = make_docs(rows)
    mixed = mixing.mix(mixing.quality_weights(docs, spark.createDataFrame([], "doc_id long, quality int")))
    taken = Counter()
    for m in mixed.collect():
        taken[m["source_size"]] += m["taken"]
    copied = Counter()
    for c in mixing.copies(docs, mixed).collect():
        copied[c["source"]] += len(c["text"].split())
    sizes = {"a": 10, "b": 18, None: 4}
    assert all(0 <= taken[sizes[s]] - copied[s] <= 1 for s in sizes)


def test_good_documents_are_drawn_first(spark):
    draw = np.random.default_rng(3).random(4000).tolist()
    rows = spark.createDataFrame([(i, 0, "a" if i % 2 else "b", 10, 1.0 if i % 4 < 2 else 0.1, draw[i]) for i in range(4000)], "doc_id long, row long, source string, size long, weight double, u double")
    got = mixing.mix(rows).join(rows.select("doc_id", "source", "weight"), "doc_id")
    share = {r["weight"]: r["t"] for r in got.filter("source = 'b'").groupBy("weight").agg(F.avg(F.col("taken") / F.col("size")).alias("t")).collect()}
    assert share[1.0] > 1.5 * share[0.1]


@pytest.mark.parametrize("weight", [1e-6, 0.1, 1.0, 40.0])
def test_ranges_are_small_whatever_the_weights(spark, weight):
    keys = spark.range(200_000).select((-F.log((F.col("id") + 0.5) / 200_000) / weight).alias("key"))
    places = keys.groupBy(mixing._place(F.col("key")).alias("place"))
    assert places.count().agg(F.max("count")).first()[0] <= 3
    coarse = keys.groupBy(F.floor(mixing._place(F.col("key")) / mixing.FAN)).count().agg(F.max("count")).first()[0]
    assert coarse < 0.02 * 200_000
    ordered = keys.select("key", mixing._place(F.col("key")).alias("place")).orderBy("key").toPandas()["place"]
    assert ordered.is_monotonic_increasing


@pytest.fixture(scope="module")
def encoder():
    return queries.tokenizer()


def test_packing(spark, make_docs, prose, edges, encoder):
    rows = [(100 + i, prose(i, 1 + (i * 37) % 900)) for i in range(120)] + [(500, "ends <|endoftext|> here"), (501, prose(1, 9000))] + [e for n, e in enumerate(edges) if n != 6]
    slow = packing.Encoder(encoder["path"], None, None)
    texts = dict(rows)
    pieces = packing.pack(make_docs(rows), hold=16, **encoder).collect()
    seen, sequences = {}, {}
    for p in pieces:
        seen.setdefault(p["doc_id"], []).append(p)
        sequences.setdefault(p["sequence_id"], []).append(p)
    assert seen.keys() == texts.keys()
    for doc, own in seen.items():
        ids = slow.ids(texts[doc])
        own.sort(key=lambda p: p["start"])
        assert [p["start"] for p in own] == [0, *np.cumsum([p["length"] for p in own])[:-1]]
        assert np.concatenate([p["ids"] for p in own]).tolist() == ids.tolist()
        for p in own:
            assert p["ids_crc32"] == zlib.crc32(ids[p["start"] : p["start"] + p["length"]].tobytes()) and p["doc_tokens"] == len(ids)
    for own in sequences.values():
        own.sort(key=lambda p: p["offset"])
        total = sum(p["length"] for p in own)
        assert [p["offset"] for p in own] == [0, *np.cumsum([p["length"] for p in own])[:-1]]
        assert total <= 2048 and total & (total - 1) == 0
    again = packing.pack(make_docs([(4, "one")] * 3), **encoder).collect()  # rows that repeat an id and a text
    assert len(again) == 3 and sorted(p["offset"] for p in again if p["sequence_id"] == again[0]["sequence_id"])[0] == 0
    assert packing.pack(make_docs([]), **encoder).count() == 0


def test_both_encoders_agree(encoder, spark):
    fast, slow = packing.Encoder(**encoder), packing.Encoder(encoder["path"], None, None)
    texts = [r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    r = random.Random(12)
    kinds = ["aZ", " \n\t\r\x0b\xa0\u2003", "0123456789", ".,;:'\"!?-_()[]{}<>|/\\", "éßñçøÅ", "日本語한글", "\U0001f600\u200d\u0301\ufe0f", "'s't'll"]
    texts += ["".join(r.choice(r.choice(kinds)) for _ in range(r.randrange(60))) for _ in range(4000)]
    texts += ["", " ", "\n\n a\t b", "it's 12345 日本語 \U0001f600", "x" * 5000, "é‍!?", "<|endoftext|>", "a  b   c    "]
    for t in texts:
        assert fast.ids(t).tolist() == slow.ids(t).tolist()


def test_costs_are_balanced():
    r = random.Random(8)
    lengths = [r.randrange(1, 1200) for _ in range(400)]
    made, rest = packing.assign(lengths, 2048, 1.0, 1 / 2048, last=False)
    assert all(sum(n for _, _, n in s) == 2048 for s in made) and sum(n for _, _, n in rest) < 2048
    costs = [sum(packing.cost(n, 1.0, 1 / 2048) for _, _, n in s) for s in made]
    assert max(costs) < 1.5 * min(costs)


def test_filling_by_turns():
    """Slot by slot: a shard's turn takes the first free slot of its preference."""
    shards, slots = ["x", "yy", "z-3", "w"], 101
    prefer = []
    for name in shards:
        offset = int(hashlib.md5(f"offset|{name}".encode()).hexdigest()[:15], 16) % slots
        skip = int(hashlib.md5(f"skip|{name}".encode()).hexdigest()[:15], 16) % (slots - 1) + 1
        prefer.append([(offset + j * skip) % slots for j in range(slots)])
    assert all(sorted(p) == list(range(slots)) for p in prefer)
    owner = {}
    while len(owner) < slots:
        for k, p in enumerate(prefer):
            free = next((s for s in p if s not in owner), None)
            if free is not None:
                owner[free] = k
    assert sharding.fill(shards, slots) == [owner[s] for s in range(slots)]


def test_sharding(spark, make_docs, edges):
    shards = [f"shard-{i}" for i in range(10)]
    owner = sharding.fill(shards, 1009)
    count = Counter(owner)
    assert max(count.values()) - min(count.values()) <= 1
    less = sharding.fill(shards[:-1], 1009)
    moved = sum(a != b for a, b in zip(owner, less) if a != 9)
    assert moved < 0.25 * 1009
    docs = make_docs([(i, "x") for i in range(2000)] + edges)
    placed = sharding.place(docs, "doc_id", shards, 1009)
    rows = placed.collect()
    assert len(rows) == 2000 + len(edges) and set(placed.columns) == set(docs.columns)
    assert all(r["shard"] == shards[owner[r["slot"]]] for r in rows)
    spread = Counter(r["shard"] for r in rows)
    assert max(spread.values()) < 1.4 * min(spread.values())
    assert "Python" not in placed._jdf.queryExecution().executedPlan().toString()
    assert sharding.place(docs.limit(0), "doc_id", shards, 1009).count() == 0
    for bad in ((["a", "a"], 7), (["a"], 8), ([], 7)):
        with pytest.raises(ValueError):
            sharding.fill(*bad)


def test_pipeline_of_odd_rows(spark, make_docs, prose, edges, tmp_path):
    """Nulls, repeats, clashing names and an empty table, stage by stage."""
    import corpus_pipeline as pipeline

    rows = [(100 + i, prose(i, 120), "en", ["a", None][i % 2]) for i in range(30)] + [(None, prose(2, 120), "en", None), (None, prose(50, 120), "en", "a"), (None, None), (105, prose(60, 120)), (105, prose(5, 120))] + [(i, t) for i, t in edges]
    spark.createDataFrame([(100 + i, int(i % 5 > 0), 0) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for n, docs in enumerate((make_docs(rows), make_docs([]))):
        columns = docs.columns
        for k, (name, stage) in enumerate(pipeline.STAGES):
            out = stage(spark, docs, str(tmp_path))
            assert name == "pack" or out.columns == columns
            out.write.parquet(str(tmp_path / f"{n}-{k}"))
            docs = spark.read.parquet(str(tmp_path / f"{n}-{k}"))
            if n:
                assert docs.count() == 0
            elif k < 3:
                assert docs.filter("doc_id is null").count() == 2
        if not n:
            assert docs.filter("doc_id is null").count() >= 1


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as pipeline

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    counts = [docs.count()]
    for k, (name, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, docs, folder)
        if k < len(pipeline.STAGES) - 1:
            assert out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        counts.append(docs.count())
    assert counts[0] > counts[1] > counts[2] == counts[3]
    clean = spark.read.parquet(str(tmp_path / "2"))
    assert clean.filter(F.col("text").rlike(r"[a-z.0-9]+@mail[0-9]\.example\.com")).count() == 0
    assert clean.filter(F.length("text") != F.col("n_chars")).count() == 0
    kept = {r["doc_id"] for r in spark.read.parquet(str(tmp_path / "3")).collect()}
    assert {r["doc_id"] for r in docs.collect()} == kept
    assert pipeline.run(spark, folder).count() == counts[-1]
