import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text) or (doc_id, text, lang, source), with columns
    whose names operators use inside."""
    from pyspark.sql import functions as F

    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, DOCS)
        return df.withColumns({c: F.lit("clash") for c in ("score", "kept", "fp", "size", "slot", "shard", "prefix", "passages", "t", "g", "key")})

    return make


@pytest.fixture(scope="session")
def prose():
    """Seeded nonsense: ``prose(seed, n)`` is n words."""
    import random

    def make(seed, n, words=300):
        r = random.Random(seed)
        return " ".join("".join(r.choice("abcdefghij") for _ in range(3 + k % 5)) for k in (r.randrange(words) for _ in range(n)))

    return make


EDGES = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "word " * 30_000), (None, "no id at all"), (4, "one"), (7, "a b  c é 日本 \U0001f600")]


@pytest.fixture(scope="session")
def edges():
    return EDGES
