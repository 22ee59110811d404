"""Token counts, collocations and spelling variants, against whole encodings and brute force."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from nomina.llm import collocations, spelling, tokencount


@pytest.fixture(scope="module")
def model():
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


ALPHABETS = (["a", "b", "the ", "  ", "▁", "\n", "é", "日本", "\U0001f600", "\x00", "ing", "tion ", " ", "x" * 7, "<0x0A>", "<s>"], ["a"], ["ab", "a"], ["\U0001f9ff", "日"], [" "])


def test_spliced_ids_are_those_of_the_whole_text(model):
    encoder, r = tokencount.Encoder(model), random.Random(1)
    assert encoder.splices
    for _ in range(1500):
        encoder.size, encoder.overlap = r.choice([(8, 2), (40, 6), (100, 20), (5, 1)])
        words = r.choice(ALPHABETS)
        text = "".join(r.choice(words) for _ in range(r.randrange(1, 300)))
        whole = encoder.model.encode(text)
        assert encoder.ids(text).tolist() == whole
        assert encoder.counts([None, text, ""]) == [0, len(whole), 0]


def test_texts_that_never_fall_into_step(model):
    encoder = tokencount.Encoder(model, 64, 8)
    text = "a" * 20_000  # runs of eight, cut at places that eight does not divide
    encoder.overlap = 7
    made = []
    chunk = encoder._chunk
    encoder._chunk = lambda *a: made.append(a[2] - a[1]) or chunk(*a)
    assert encoder.counts([text]) == [len(encoder.model.encode(text))]
    assert sum(made) < 8 * len(text)


def test_other_models_are_encoded_whole(model, monkeypatch):
    monkeypatch.setattr(tokencount, "mergeable", lambda _: False)
    encoder = tokencount.Encoder(model, 8, 2)
    assert not encoder.splices and encoder.counts(["some words " * 50]) == [len(encoder.model.encode("some words " * 50))]
    with pytest.raises(ValueError):
        tokencount.Encoder(model, 8, 8)


def test_token_counts(spark, make_docs, edges, model):
    rows = [*edges, (9, "word " * 5000)]
    got = tokencount.count_tokens(make_docs(rows), model, size=1000, overlap=16).collect()
    encode = tokencount.Encoder(model).model.encode
    want = [(i, len((t or "").encode()), len(encode(t or "")), len(encode(t or "")) > 4096) for i, t in rows]
    assert sorted(map(tuple, got), key=lambda r: (r[0] or 0, r[1:])) == sorted(want, key=lambda r: (r[0] or 0, r[1:]))
    assert tokencount.count_tokens(make_docs(rows[:1]).limit(0), model).count() == 0


def plain_collocations(rows, least, top):
    n, f = Counter(), defaultdict(Counter)
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 5):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        inside = defaultdict(int)
        for p, a in found.items():
            for size in range(2, len(p)):
                for i in range(len(p) - size + 1):
                    inside[p[i : i + size]] = max(inside[p[i : i + size]], a)
        scored = []
        for p, a in found.items():
            score, _, left, right = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            if 100 * inside[p] < 80 * a:
                scored.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(scored)[:top])]
    return sorted(out)


@pytest.mark.parametrize("size, bits", [(collocations.BLOCK, 26), (300, 26), (5000, 7)])
def test_collocations(spark, size, bits):
    r = random.Random(3)
    words = ["a", "b", "c", "Dd", "É", "x y", "e,", "f.", "g\n"]
    rows = [(r.choice(["en", "fr", None, "und"]), " ".join(r.choice(words[: 3 + i % 7]) for _ in range(r.randrange(60)))) for i in range(120)]
    rows += [("en", None), ("en", ""), ("fr", " \t\n..,"), ("hot", "same words in the same row " * 300), ("hot", "same words in the same row, " * 40)]
    docs = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string").withColumns({c: F.lit("clash") for c in ("word", "n", "name", "phrase", "t", "w1")})
    for least, top in ((30, 2000), (5, 40)):
        got = collocations.collocations(docs, least=least, top=top, size=size, bits=bits)
        assert sorted(map(tuple, got.collect())) == plain_collocations(rows, least, top)
    assert collocations.collocations(docs.limit(0)).count() == 0


def test_words_that_share_a_name(spark, monkeypatch):
    """Where a frequent word has another's name, another seed is taken."""
    named = collocations.named
    monkeypatch.setattr(collocations, "named", lambda w, lang, seed: F.lit(5).cast("long") if seed == 0 else named(w, lang, seed))
    rows = [("en", "one two three " * 40)]
    docs = spark.createDataFrame(rows, "lang string, text string")
    assert sorted(map(tuple, collocations.collocations(docs).collect())) == plain_collocations(rows, 30, 2000)


def test_names_are_the_same_on_both_sides(spark):
    words = ["a", "été", "日本", "x" * 100, ""]
    df = spark.createDataFrame([("fr", w) for w in words], "lang string, w string").select(collocations.named("w", "lang", 3).alias("h"))
    assert [r["h"] & (2**64 - 1) for r in df.collect()] == collocations.names_of("fr", [w.encode() for w in words], 3).tolist()


def plain_variants(rows):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += len(run) >= 7
    n = {w: c for w, c in n.items() if c >= 2}
    near = defaultdict(set)
    letters = {c for w in n for c in w}
    for w in n:
        for i in range(len(w) + 1):
            made = {w[:i] + c + w[i:] for c in letters} | {w[:i] + w[i + 1 :]} | {w[:i] + c + w[i + 1 :] for c in letters if i < len(w)}
            near[w] |= {x for x in made if x in n and x != w}
    form = {w: min(near[w], key=lambda x: (-n[x], x), default=None) for w in n}
    form = {w: f if f is not None and n[f] >= 10 * n[w] else None for w, f in form.items()}

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, form[w] or "", root(w), n[w], len(near[w]), n[form[w]] if form[w] else 0) for w in n)


def noisy(seed, texts):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdeéÿ") for _ in range(7 + i % 4)) for i in range(30)]
    words += ["intermediate" + a + b for a in "abc" for b in "xyz"]

    def typo(w):
        i, c = r.randrange(len(w)), r.choice("abcdÉ")
        return r.choice([w, w, w, w[:i] + w[i + 1 :], w[:i] + c + w[i:], w[:i] + c + w[i + 1 :], w.upper()])

    return [(i, " ".join(typo(words[min(int(r.expovariate(0.15)), len(words) - 1)]) for _ in range(200))) for i in range(texts)]


@pytest.mark.parametrize("group", [2, 64])
def test_variants(spark, make_docs, edges, group):
    rows = [*noisy(2, 25), *edges, (None, "repeated repeated Repeatedx"), (77, "aaaaaaaa-aaaaaaaa baaaaaaa " * 20), (78, "z" * 300 + " " + "z" * 300 + " " + "z" * 299 + " " + "z" * 299)]
    got = spelling.variants(make_docs(rows), group=group).collect()
    assert sorted((r[0], r[1] or "", r[2], r[3], r[4], r[5] or 0) for r in got) == plain_variants(rows)
    assert all((r["form"] is None) == (r["form_n"] is None) for r in got)
    assert spelling.variants(make_docs(rows).limit(0)).count() == 0


def test_chains_of_forms(spark):
    forms = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(11)] + [("x", "y")], "word string, form string")
    assert {r["word"]: r["root"] for r in spelling.roots(forms).collect()} == {f"w{i}": "w11" for i in range(11)} | {"x": "y"}


def test_candidates_stay_few_under_a_hot_prefix(spark):
    """Words that share a prefix are split, not paired with each other."""
    r = random.Random(4)
    words = {"commonprefix" + "".join(r.choice("abcdefghijklmnopqrst") for _ in range(10)) for _ in range(3000)}
    words |= {w[:15] + "q" + w[16:] for w in sorted(words)[:50]}
    df = spark.createDataFrame([(w, 2) for w in words], "word string, n long")
    rows = spelling.segments(df)
    assert rows.groupBy(*spelling.KEY).count().agg(F.max("count")).first()[0] >= 3000
    found = spelling.one_edit_pairs(df).collect()
    other = ((w, w[:i] + c + w[i + 1 :]) for w in words for i in range(len(w)) for c in "abcdefghijklmnopqrst")
    plain = {tuple(sorted(pair)) for pair in other if pair[1] in words and pair[0] != pair[1]}
    assert {tuple(sorted((x["u"], x["v"]))) for x in found} == plain and len(found) == len(plain)
