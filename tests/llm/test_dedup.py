"""Near and substring duplicates against brute force."""

import hashlib
import random

import numpy as np
import pytest
import xxhash

from nomina.llm import resemblance, simhash, substring, words
from nomina.llm.components import connected_components


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def components(prints):
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_near_duplicates(spark, make_docs, prose):
    rows = []
    for i in range(40):
        base = prose(i, 120).split()
        rows.append((10 * i, " ".join(base)))
        for k in range(1, 1 + i % 4):
            other = list(base)
            other[(7 * k) % 120] = f"edit{k}"
            rows.append((10 * i + k, " ".join(other).upper()))
    got = {r["doc_id"]: r for r in simhash.near_duplicates(make_docs(rows)).collect()}
    prints = {i: plain_fingerprint(t) for i, t in rows}
    assert {i: r["fp"] % (1 << 64) for i, r in got.items()} == prints
    assert {i: r["component_id"] for i, r in got.items()} == components(prints)
    kept = simhash.keep_one(make_docs(rows)).select("doc_id").collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(set(components(prints).values()))


@pytest.mark.parametrize("unfold", [500, 2_000_000])
def test_ball_hashing_finds_every_link(unfold, monkeypatch):
    monkeypatch.setattr(simhash, "UNFOLD", unfold)
    r = random.Random(5)
    base = [r.getrandbits(64) for _ in range(60)]
    prints = {i: p for i, p in enumerate(base)}
    for p in base:
        for flips in (1, 3, 4, 5):
            q = p
            for b in r.sample(range(64), flips):
                q ^= 1 << b
            prints[len(prints)] = q
    prints = dict(enumerate(sorted(set(prints.values()))))
    edges = set()
    for bucket in range(4):
        near = np.array([p for p in prints.values() if (p >> 62 ^ bucket).bit_count() <= 2], np.uint64)
        u, v = simhash.bucket_links(near, bucket, 2, 2)
        edges |= set(zip(u.tolist(), v.tolist()))
    back = {p: i for i, p in prints.items()}
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        x, y = find(back[a]), find(back[b])
        root[max(x, y)] = min(x, y)
    assert {i: find(i) for i in prints} == components(prints)


def test_components(spark):
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 140)] + [(r.randrange(60), r.randrange(60)) for _ in range(40)] + [(None, 3), (5, 5)]
    got = {x["node"]: x["root"] for x in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    near = {}
    for a, b in edges:
        if a is not None and a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    for node in near:
        seen, todo = {node}, [node]
        while todo:
            todo += [n for n in near[todo.pop()] if n not in seen and not seen.add(n)]
        assert got[node] == min(seen)
    assert len(got) == len(near)
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("few", [0, 100_000])
def test_components_of_large_stars(spark, few):
    n = 100_000
    star = spark.range(1, n).selectExpr("id u", "0L v")
    other = spark.range(n + 1, n + 500).selectExpr(f"{2 * n}L u", "id v")  # its centre is the largest
    edges = star.union(other).union(spark.createDataFrame([(n - 1, n + 7)], "u long, v long"))
    got = connected_components(edges, few=few)
    assert got.count() == n + 500 and got.filter("root <> 0").count() == 0


def test_repeated_ids_leave_the_same_row(spark, make_docs, prose):
    """Rows of an id with different texts: always the same one stays."""
    rows = [(5, prose(1, 200)), (5, prose(2, 200)), (5, prose(2, 200)), (3, prose(2, 200)), (9, prose(1, 200)), (7, prose(4, 200)), (7, prose(5, 200)), (None, prose(2, 200)), (None, None)]
    kept = [sorted(((r["doc_id"], r["text"]) for r in f(make_docs(rows).repartition(n)).collect()), key=str) for n in (1, 3) for f in (simhash.keep_one, resemblance.keep_one)]
    assert all(k == kept[0] for k in kept)
    assert [i for i, _ in kept[0]].count(5) == 1 and [i for i, _ in kept[0]].count(7) == 1 and [i for i, _ in kept[0]].count(None) == 2
    assert (3, rows[3][1]) in kept[0] and (9, rows[4][1]) not in kept[0]


def test_near_duplicates_edges(spark, make_docs, edges):
    rows = simhash.near_duplicates(make_docs(edges)).collect()
    assert len(rows) == len(edges)
    assert {r["component_id"] for r in rows if r["doc_id"] in (1, 2, 3)} == {1}
    assert simhash.near_duplicates(make_docs([])).count() == 0
    kept = [r["doc_id"] for r in simhash.keep_one(make_docs(edges)).collect()]
    assert kept.count(4) == 1 and kept.count(None) == 1 and 2 not in kept


def plain_groups(rows, least=0.8):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def test_stage_drops_copies_of_four_fifths(spark, make_docs, prose, edges):
    import corpus_pipeline

    rows = []
    for i in range(60):
        base = prose(i, 300).split()
        for k in range(1 + i % 4):
            other = list(base)
            for e in range(i % 8):  # each edit changes five shingles of 296
                other[20 + 35 * e + k] = f"edit{k}"
            rows.append((10 * i + k, " ".join(other)))
    got = {r["doc_id"]: r["component_id"] for r in resemblance.near_duplicates(make_docs(rows)).collect()}
    expected = plain_groups(rows)
    assert got == expected
    loose = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(make_docs(rows)).collect()}
    assert len(set(loose.values())) > len(set(expected.values()))
    kept = corpus_pipeline.near_dedup(spark, make_docs(rows), "").select("doc_id").collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(set(expected.values()))
    kept = [r["doc_id"] for r in resemblance.keep_one(make_docs(edges)).collect()]
    assert kept.count(4) == 1 and kept.count(None) == 1 and kept.count(1) == 1 and 2 not in kept
    assert resemblance.near_duplicates(make_docs([])).count() == 0


@pytest.mark.parametrize("small, together, heads", [(0, 4, 0), (16, 64, 0), (0, 7, 2)])
def test_no_link_of_a_key_is_lost(spark, make_docs, prose, monkeypatch, small, together, heads):
    """Copies that differ more from each other than from an original that is not
    there: heads miss most links."""
    for name, value in (("SMALL", small), ("TOGETHER", together), ("HEADS", heads), ("FEW", 0)):
        monkeypatch.setattr(resemblance, name, value)
    r, base, rows = random.Random(5), prose(77, 240).split(), []
    for i in range(60):
        other = list(base)
        for _ in range(r.randrange(3, 9)):
            other[r.randrange(len(other))] = f"own{r.randrange(40)}"
        rows.append((i, " ".join(other)))
    rows += [(100 + i, prose(i, 80)) for i in range(10)] + [(200, rows[3][1]), (3, rows[3][1])]
    got = {x["doc_id"]: x["component_id"] for x in resemblance.near_duplicates(make_docs(rows)).collect()}
    assert got == plain_groups(rows) and 12 < len(set(got.values())) < 60


def plain_removal(rows, window=50):
    texts = [(i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, w in texts:
        if i is not None:
            for k in range(len(w) - window + 1):
                key = tuple(w[k : k + window])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, w in texts:
        gone = set()
        if i is not None:
            for k in range(len(w) - window + 1):
                if first[tuple(w[k : k + window])] < i:
                    gone |= set(range(k, k + window))
        kept = b" ".join(x for n, x in enumerate(w) if n not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("group, window", [(2, 50), (5, 50), (8192, 50), (3, 12), (8192, 61)])
def test_remove_repeats(spark, make_docs, prose, edges, group, window):
    shared = [prose(900 + k, n) for k, n in enumerate((49, 50, 51, 80, 200))]
    line = prose(990, 14)  # common to many texts, in different surroundings
    phrase = prose(991, 34)
    r = random.Random(2)
    rows = [(i, " ".join([prose(i, r.randrange(90)), r.choice(shared), prose(i + 500, r.randrange(60)), r.choice(shared)])) for i in range(60)]
    rows += [(100 + i, rows[i][1]) for i in range(10)] + [(200, "same word " * 200), (201, "same word " * 60)]
    rows += [(210 + i, f"{prose(700 + i, 60)} {line} {prose(800 + i, 60)}") for i in range(25)]
    rows += [(240 + i, f"{prose(600 + i, 40)} {phrase} {prose(650 + i % 3, 70)}") for i in range(25)]
    # Repeated ids: other texts, a text shorter than its twin, and equal rows.
    rows += [(300, prose(1, 60)), (305, prose(2, 300) + " " + prose(1, 60)), (305, "q " * 400), (305, prose(2, 80))]
    rows += [(299, prose(2, 70)), (310, prose(3, 90)), (310, prose(3, 90)), (310, prose(3, 90) + " more"), (311, prose(3, 90)), (311, prose(3, 90))]
    rows += [(1000 + i if i is not None else None, t) for i, t in edges if t is None or len(t) < 1000] + [(None, prose(3, 90))]
    got = substring.digest(substring.remove_repeats(make_docs(rows), window=window, group=group)).collect()
    assert sorted([(x["doc_id"], x["n_words"], x["n_removed"], x["kept_sha256"]) for x in got], key=str) == plain_removal(rows, window)


def test_words_and_anchors_do_not_depend_on_the_batch(prose, monkeypatch):
    texts = [prose(k, 40 + 37 * k).encode() for k in range(30)] + [b"", None, b"  \t", b"x" * 5000, "é 日本 ".encode() * 60]
    whole = substring.runs(texts, 50)
    monkeypatch.setattr(substring, "WORDS", 64)
    again = substring.runs(texts, 50)
    assert all((a == b).all() for a, b in zip(whole, again))
    alone = [substring.runs([t], 50) for t in texts]
    assert np.concatenate([a[1] for a in alone]).tolist() == whole[1].tolist()
    assert [n for a in alone for n in a[3].tolist()] == whole[3].tolist()
    assert len(words.word_hashes(texts)[0]) == sum(len((t or b"").split()) for t in texts)


def test_suffixes_are_sorted_and_their_common_prefixes_known():
    r = random.Random(7)
    ids = np.array([r.randrange(3) for _ in range(400)] + [0] * 100)
    starts = np.array(r.sample(range(450), 300))
    order, shared = substring.sort_suffixes(ids, starts, 50)
    sorted_ = [tuple(ids[starts[k] : starts[k] + 50]) for k in order]
    plain = [0] + [next((n for n, (x, y) in enumerate(zip(a, b)) if x != y), 50) for a, b in zip(sorted_, sorted_[1:])]
    assert shared.tolist() == plain
    # A node's leaves are neighbours: as many groups as there are different texts.
    assert (shared < 50).sum() == len(set(sorted_))


def test_groups_are_split_until_they_fit(spark, make_docs, prose, monkeypatch):
    """A line of 32 words in 40 texts: every length of prefix is tried."""
    tried, lengthened = [], substring._lengthened
    monkeypatch.setattr(substring, "_lengthened", lambda p, w, n: tried.append(n) or lengthened(p, w, n))
    line = prose(5, 32)
    rows = [(i, f"{prose(100 + i, 70)} {line} {prose(200 + i // 2, 80)}") for i in range(40)]
    got = substring.digest(substring.remove_repeats(make_docs(rows), group=4)).collect()
    assert tried == [16, 23, 30]
    assert sorted([(x["doc_id"], x["n_words"], x["n_removed"], x["kept_sha256"]) for x in got], key=str) == plain_removal(rows)


def test_groups_stay_whole_beside_one_that_is_split(spark, make_docs, prose):
    """A line in 40 texts makes a large group; the small groups beside it are in
    one task each, however adaptive execution reads its shuffles."""
    line = prose(5, 32)
    rows = [(i, f"{prose(300 + i % 60, 90)} {prose(700 + i, 30)}") for i in range(120)]
    rows += [(200 + i, f"{prose(100 + i, 70)} {line} {prose(200 + i // 2, 80)}") for i in range(40)]
    keep = "spark.sql.adaptive.coalescePartitions.enabled"  # as where tables are large
    spark.conf.set(keep, "false")
    try:
        got = substring.digest(substring.remove_repeats(make_docs(rows), group=8)).collect()
    finally:
        spark.conf.unset(keep)
    assert sorted([(x["doc_id"], x["n_words"], x["n_removed"], x["kept_sha256"]) for x in got], key=str) == plain_removal(rows)


def test_words_that_collide_in_polynomials_are_different(spark, make_docs, prose):
    """Thue and Morse's words of 1,024 letters have equal polynomial hashes modulo
    2 ** 64 under any odd base."""
    signs = [bin(i).count("1") % 2 for i in range(1024)]
    a, b = ("".join("ab"[s ^ k] for s in signs) for k in (0, 1))
    rows = [(1, f"{a} {prose(1, 49)}"), (2, f"{b} {prose(1, 49)}"), (3, f"{b} {prose(1, 49)}"), (4, f"{prose(1, 49)} {a}")]
    rows += [(10 + k, " ".join(a if s ^ k % 2 else b for s in signs) + f" end{k % 2}") for k in range(4)]
    for group in (8192, 2):
        got = substring.digest(substring.remove_repeats(make_docs(rows), group=group)).collect()
        assert sorted([(x["doc_id"], x["n_words"], x["n_removed"], x["kept_sha256"]) for x in got], key=str) == plain_removal(rows)


@pytest.mark.parametrize("differ", ["across", "within"])
def test_hashes_that_collide_are_found(spark, make_docs, prose, monkeypatch, differ):
    """Under the first seed two words have one hash: refused. Under another, right."""
    missing = words._Hashes.__missing__

    def same(self, word):
        return missing(self, b"left" if self.seed == 0 and word == b"right" else word)

    monkeypatch.setattr(words._Hashes, "__missing__", same)
    text = lambda w: f"{prose(1, 120)} {w} {prose(2, 120)}"
    rows = [(1, text("left")), (2, text("right"))] if differ == "across" else [(1, text("left") + " " + prose(3, 60) + " " + text("right")), (2, prose(4, 90))]
    with pytest.raises(Exception, match="take another"):
        substring.remove_repeats(make_docs(rows)).collect()
    got = substring.digest(substring.remove_repeats(make_docs(rows), seed=1)).collect()
    assert sorted([(x["doc_id"], x["n_words"], x["n_removed"], x["kept_sha256"]) for x in got], key=str) == plain_removal(rows)


def test_remove_repeats_of_nothing(spark, make_docs):
    assert substring.remove_repeats(make_docs([])).count() == 0
    with pytest.raises(ValueError):
        substring.remove_repeats(make_docs([]), window=10)


def _tasks(spark, run):
    """What ``run`` gives, and how many tasks it took with 50 shuffle partitions."""
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "50")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.sparkContext.setJobGroup("counted", "counted")
    try:
        out, told = run(), spark.sparkContext.statusTracker()
        stages = {s for j in told.getJobIdsForGroup("counted") for s in told.getJobInfo(j).stageIds}
        return out, sum(i.numCompletedTasks for i in map(told.getStageInfo, stages) if i)
    finally:
        spark.sparkContext._jsc.clearJobGroup()
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_few_edges_take_few_tasks(spark):
    """Rounds over few edges shuffled them through all partitions, and the log and
    files of their tasks filled the disk."""
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)], "u long, v long")
    got, tasks = _tasks(spark, lambda: {(x["node"], x["root"]) for x in connected_components(edges).collect()})
    assert got == {(i, 0) for i in range(41)}
    assert tasks < 600
