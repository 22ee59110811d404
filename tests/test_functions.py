"""Golden values of the name rules, derived by hand."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from nomina.functions import scripts, text, vectors


def one(spark, fn, *values):
    rows = spark.createDataFrame([(v,) for v in values], "v string").select(fn(F.col("v")).alias("r")).collect()
    return [r["r"] for r in rows]


def variants(spark, fn, name):
    return [(v["variant"], v["variant_type"]) for v in one(spark, fn, name)[0]]


@pytest.mark.parametrize(
    "fn, value, expected",
    [
        (text.remove_legal_suffix, "Custody Bank of Japan, Ltd.", "Custody Bank of Japan,"),
        (text.remove_legal_suffix, "PUBLIC COMPANY", "PUBLIC"),
        (text.remove_legal_suffix, "Acme LTD Trading", "Acme LTD Trading"),
        (text.abbreviate, "Acme International Management Co.", "Acme INTL MGMT Co."),
        (text.expand, "Acme INTL Corp.", "Acme International Corporation"),
        (text.remove_prepositions, "Bank of the West", "Bank West"),
        (text.remove_prepositions, "of the", "of the"),
        (text.drop_words, "A B C D", "A B D"),
        (text.drop_words, "A B C", "A B"),
        (text.drop_words, "A B", "A B"),
        (text.drop_patronymic, "Бычков Владимир Петрович", "Бычков Петрович"),
        (text.reverse_name_order, "Jose Luis Sanz Ruiz", "Ruiz Jose"),
        (text.without_legal_entity, "Acme Trading Company, Ltd.", "Acme Trading , ."),
        (text.complexity, "John Smith", "simple"),
        (text.complexity, "John W Smith", "medium"),
        (text.complexity, "Smith, J.", "complex"),
        (text.complexity, "", "empty"),
        (scripts.dominant_of_five, "12345", "other"),
        (scripts.dominant_of_five, "   ", "latin"),
        (scripts.dominant_of_five, "[\\]^_", "latin"),
        (scripts.dominant_of_five, "", "empty"),
        (scripts.majority, "Иванов Ivan", "Mixed"),
        (scripts.majority, "12345", "Unknown"),
        (scripts.first_seen, "ABC абв", "LATIN"),
        (scripts.first_seen, "...", "UNKNOWN"),
        (scripts.first_seen, "日本銀行", "CJK"),
        (scripts.dominant_letters, "é", "Other"),
        (scripts.dominant_letters, "ç", "Turkish"),
        (scripts.dominant_letters, "日", "CJK"),
    ],
)
def test_golden(spark, fn, value, expected):
    assert one(spark, fn, value) == [expected]


def test_variants(spark):
    assert variants(spark, text.person_variants, "John Smith") == [("Smith John", "name_order_reversed")]
    assert [v for v, _ in variants(spark, text.abbreviated_person, "John William Smith")] == ["J Smith", "J. Smith", "John W Smith"]
    assert [v for v, _ in variants(spark, text.fuzzy_variants, "Müller-Öl, Inc.")] == ["MüllerÖl Inc", "Müller Öl, Inc."]
    assert [v for v, _ in variants(spark, text.partial_variants, "John William Smith")] == ["John Smith", "Smith"]


def test_script_sets(spark):
    assert one(spark, scripts.script_set, "Nintendo 任天堂", "123", None) == [["CJK", "Latin"], [], None]


def test_small_functions(spark):
    row = spark.range(1).select(
        text.hhmmss(F.lit(3725.9)).alias("t"), text.probabilistic_or(F.lit(50.0), F.lit(50.0)).alias("p"), text.bucket(F.lit(43), "BIZNAME").alias("b"),
        text.truncated(F.lit("x" * 70)).alias("s"), text.lexical_score(F.lit("Acme Bank"), F.lit("acme trading bank")).alias("l"),
    ).first()
    assert (row["t"], row["p"], row["b"], len(row["s"]), row["l"]) == ("01:02:05", 75.0, "likely", 60, 66)


def test_vectors(spark):
    row = spark.createDataFrame([([3.0, 4.0, 12.0],)], "v array<float>").select(
        vectors.matryoshka(F.col("v"), 2).alias("m"), vectors.norm(F.col("v")).alias("n"), vectors.from_text(vectors.to_text(F.col("v"))).alias("t"), vectors.half_precision(F.col("v")).alias("h")
    ).first()
    assert (row["m"], row["n"], row["t"], row["h"]) == ([0.6, 0.8], 13.0, [3.0, 4.0, 12.0], [3.0, 4.0, 12.0])


def test_encoder(spark):
    names = spark.createDataFrame([("Acme Trading",), ("Acme Trading",), ("Custody Bank of Japan",), (None,)], "name string")
    rows = vectors.encode_names(names, "name", vectors.hash_encoder(64, n=1), dim=16).collect()
    assert len(rows) == 4
    assert all(r["embedding"] is None if r["name"] is None else len(r["embedding"]) == 16 for r in rows)
    assert all(r["embedding"] is None if r["name"] is None else abs(np.linalg.norm(r["embedding"]) - 1) < 1e-5 for r in rows)
    x = np.arange(12.0).reshape(1, 3, 4)
    assert np.allclose(vectors.mean_pool(x, np.array([[1, 1, 0]])), x[:, :2].mean(axis=1))
    assert np.allclose(vectors.pool(x, np.ones((1, 3)), first=True), x[:, 0])
    assert vectors.dense(np.ones((1, 4)), np.ones((2, 4)), np.zeros(2)).shape == (1, 2)


def test_model_encoder(monkeypatch):
    """Pooling and the dense layer follow the model's configuration; the session
    is opened once. The runtime and the tokenizer are stand-ins."""
    import sys
    import types

    opened = []

    class Session:
        def __init__(self, path, options):
            opened.append((path, options.intra_op_num_threads))

        def get_inputs(self):
            return [types.SimpleNamespace(name=n) for n in ("input_ids", "attention_mask", "token_type_ids")]

        def run(self, _, feed):
            assert set(feed) == {"input_ids", "attention_mask", "token_type_ids"} and not feed["token_type_ids"].any()
            return [np.stack([feed["input_ids"], 2.0 * feed["input_ids"]], axis=2)]

    class Tokenizer:
        @classmethod
        def from_file(cls, path):
            return cls()

        def enable_truncation(self, n):
            self.most = n

        def enable_padding(self, length):
            assert length == self.most

        def encode_batch(self, names):
            made = [[ord(c) % 32 for c in n][: self.most] for n in names]
            return [types.SimpleNamespace(ids=m + [0] * (self.most - len(m)), attention_mask=[1] * len(m) + [0] * (self.most - len(m))) for m in made]

    monkeypatch.setitem(sys.modules, "onnxruntime", types.SimpleNamespace(SessionOptions=types.SimpleNamespace, InferenceSession=Session))
    monkeypatch.setitem(sys.modules, "tokenizers", types.SimpleNamespace(Tokenizer=Tokenizer))
    first = vectors.onnx_encoder("m", "t", max_length=4)
    assert first(["abc", "d"]).tolist() == [[1, 2], [4, 8]] and first(["b"]).tolist() == [[2, 4]] and opened == [("m", 1)]
    mean = vectors.onnx_encoder("m", "t", {"pooling_mode_mean_tokens": True}, max_length=4)
    assert mean(["abc", "d"]).tolist() == [[2, 4], [4, 8]]
    both = vectors.onnx_encoder("m", "t", {"pooling_mode_cls_token": True, "pooling_mode_mean_tokens": True}, max_length=4)
    assert both(["abc"]).tolist() == [[1, 2]]
    weight, bias = np.array([[0.5, 0.0], [0.0, -0.25]]), np.array([0.1, 0.2])
    made = vectors.onnx_encoder("m", "t", layer={"weight": weight, "bias": bias, "activation": "torch.nn.modules.activation.Tanh"}, max_length=4)
    assert np.allclose(made(["abc"]), np.tanh([[0.6, -0.3]]))
    plain = vectors.onnx_encoder("m", "t", layer={"weight": weight, "activation": None}, max_length=4)
    assert np.allclose(plain(["abc"]), [[0.5, -0.5]])


def test_table_functions_are_the_rules(spark):
    """Each table function against its column expression, in lateral joins."""
    from nomina.functions import tables

    names = spark.createDataFrame([(i, n) for i, n in enumerate(["Acme International Management Co.", "John W Smith", "Bank of the West", "it's", "", None, "A, B & \"C\" Ltd.", "Иванов Ivan Петрович", "x" * 50])], "id int, name string")
    names.createOrReplaceTempView("some_names")
    assert tables.register(spark) == list(tables.RULES)
    for function, rule in tables.RULES.items():
        got = spark.sql(f"SELECT id, v.* FROM some_names AS n, LATERAL {function}(n.name) AS v").collect()
        plain = names.select("id", F.posexplode(rule(F.col("name"))).alias("nth", "v")).select("id", "nth", "v.variant", "v.variant_type").collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, plain)) and plain
        assert spark.sql(f"SELECT * FROM {function}('John William Smith Co.')").count() > 0


def test_operators_become_functions(spark):
    from nomina.functions import tables

    c = F.when((F.col("a") >= 2) & ~(F.col("a") == 5) | F.col("a").isNull(), F.concat(F.lit("it's =( \\"), -F.col("a") + 1)).otherwise("<(")
    df = spark.createDataFrame([(1,), (3,), (5,), (None,)], "a int")
    assert df.select(F.expr(tables.sql_of(c)).alias("c")).collect() == df.select(c.alias("c")).collect()
