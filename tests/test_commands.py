"""Commands from file to file, as a user would chain them."""

import json

import pytest

from nomina.__main__ import main


def read(spark, path):
    return [json.loads(r["value"]) for r in spark.read.text(str(path)).collect()]


def test_records_to_variants(spark, tmp_path):
    lines = [
        {"DATA_SOURCE": "S", "RECORD_ID": f"r{i}", "RECORD_TYPE": "PERSON" if i % 2 else "ORGANIZATION", "EXTRA": i,
         "NAMES": [{"NAME_TYPE": "PRIMARY", "NAME_FULL" if i % 2 else "NAME_ORG": f"Acme {i} Trading Bank Ltd"}, {"NAME_FULL" if i % 2 else "NAME_ORG": f"Акме {i}"}]}
        for i in range(40)
    ]
    (tmp_path / "in.jsonl").write_text("\n".join(json.dumps(x) + "," for x in lines))
    main(["sample", str(tmp_path / "in.jsonl"), str(tmp_path / "s"), "--size", "10"], spark)
    taken = [json.loads(r["value"].rstrip(",")) for r in spark.read.text(str(tmp_path / "s")).collect()]
    assert len(taken) == 10 and all("EXTRA" in t for t in taken)
    main(["cases", str(tmp_path / "s"), str(tmp_path / "c"), "--filter", "organization", "--date", "2025-01-01"], spark)
    cases = read(spark, tmp_path / "c")
    assert len(cases) == 10 and {c["record_type"] for c in cases} == {"ORGANIZATION"}
    main(["variants", str(tmp_path / "c"), str(tmp_path / "v")], spark)
    assert {v["variant_type"] for v in read(spark, tmp_path / "v")} >= {"legal_suffix_removed", "word_dropped"}
    main(["aliases", str(tmp_path / "in.jsonl"), str(tmp_path / "t")], spark)
    found = read(spark, tmp_path / "t")
    assert found and all(t["anchor"] != t["negative"] for t in found)


def test_entities_to_triplets(spark, tmp_path):
    rows = ["id,canonical,name,language"] + [f'Q{i},"N{i}","{n} {i % 7}",en' for i in range(30) for n in ("Acme Bank", "Акме Банк", "Acme Trading Bank", "Bank Acme")]
    (tmp_path / "a.csv").write_text("\n".join(rows))
    main(["entities", str(tmp_path / "a.csv"), str(tmp_path / "e"), "--size", "20"], spark)
    made = read(spark, tmp_path / "e")
    assert len(made) == 16 and all(len(e["aliases"]) == 4 for e in made)
    main(["prepare", str(tmp_path / "e"), str(tmp_path / "p")], spark)
    assert len(read(spark, tmp_path / "p")[0]["NAMES"]) == 4
    main(["align", str(tmp_path / "e"), str(tmp_path / "pairs"), "--dim", "64"], spark)
    pairs = read(spark, tmp_path / "pairs")
    assert {p["same_entity"] for p in pairs} == {True, False}
    main(["analyze", str(tmp_path / "pairs"), str(tmp_path / "report")], spark)
    assert 0 <= read(spark, tmp_path / "report")[0]["auc"] <= 1
    main(["triplets", str(tmp_path / "pairs"), str(tmp_path / "t"), "--positive", "50", "--negative", "60", "--include-null"], spark)
    assert all(t["anchor"] != t["positive"] for t in read(spark, tmp_path / "t"))
    main(["hard", str(tmp_path / "pairs"), str(tmp_path / "h")], spark)


def test_responses_to_report(spark, tmp_path):
    entity = lambda i, g, e: {"ENTITY": {"RESOLVED_ENTITY": {"ENTITY_ID": i}}, "MATCH_INFO": {"FEATURE_SCORES": {"NAME": [{"SCORE": g}], "NAME_EMBEDDING": [{"SCORE": e}]}}}
    cases = [{"case_id": f"c{i}", "record_type": "PERSON", "variant_type": "v", "query_name_type": "primary_Latin", "expected_entity_id": i} for i in range(4)]
    answers = [{"case_id": f"c{i}", "mode": m, "response": json.dumps({"RESOLVED_ENTITIES": [entity(i, 50, 90 - 10 * i), entity(9, 60, 75)] if i < 3 else []})} for i in range(4) for m in ("name", "emb")]
    (tmp_path / "c.jsonl").write_text("\n".join(map(json.dumps, cases)))
    (tmp_path / "r.jsonl").write_text("\n".join(map(json.dumps, answers)))
    main(["evaluate", str(tmp_path / "c.jsonl"), str(tmp_path / "out"), "--responses", str(tmp_path / "r.jsonl")], spark)
    got = {(x["section"], x["part"], x["metric"]): x["value"] for x in read(spark, tmp_path / "out")}
    assert got["retrieval", "", "cases"] == 4 and got["retrieval", "", "emb_recall_1"] == 50 and got["retrieval", "", "emb_not_found"] == 25
    assert got["relative_ranking", "emb", "both_found_wrong_order"] == pytest.approx(100 / 3)
    assert got["rank_distribution", "emb:not_found", "cases"] == 1 and got["breakdown", "record_type:PERSON", "cases"] == 4


def test_reports_attempts_and_lines(spark, tmp_path):
    (tmp_path / "reports").mkdir()
    for n, acc in (("a", 90.0), ("b", 70.0)):
        (tmp_path / "reports" / f"{n}.json").write_text(json.dumps({"test_set": "t", "model_type": "personal", "model_path": f"/m/{n}", "emb_accuracy": acc, "emb_ndcg": {"10": 0.5}}, indent=1))
    main(["compare", str(tmp_path / "reports"), str(tmp_path / "cmp")], spark)
    assert {(x["model_path"], x["behind"]) for x in read(spark, tmp_path / "cmp")} == {("/m/a", 0.0), ("/m/b", 20.0)}
    main(["compare", str(tmp_path / "reports"), str(tmp_path / "best"), "--best-only"], spark)
    assert [x["model_path"] for x in read(spark, tmp_path / "best")] == ["/m/a"]
    log = [("x", 1, "timed out"), ("x", 2, None), ("y", 1, "too long"), ("z", 1, "timeout"), ("z", 2, "timeout")]
    (tmp_path / "log.jsonl").write_text("\n".join(json.dumps({"record_id": r, "attempt": n, "message": m}) for r, n, m in log))
    main(["retry", str(tmp_path / "log.jsonl"), str(tmp_path / "last")], spark)
    assert {(x["record_id"], x["attempts"], x["outcome"]) for x in read(spark, tmp_path / "last")} == {("x", 2, "success"), ("y", 1, "too_long"), ("z", 2, "retryable")}
    main(["numbers", str(tmp_path / "log.jsonl"), str(tmp_path / "n")], spark)
    assert sorted(x["ordinal"] for x in read(spark, tmp_path / "n")) == [1, 2, 3, 4, 5]


def test_load_and_why(spark, tmp_path):
    record = lambda i, name: {"DATA_SOURCE": "S", "RECORD_ID": i, "RECORD_TYPE": "PERSON", "NAMES": [{"NAME_TYPE": "PRIMARY", "NAME_FULL": name}] if name else []}
    first = [record("1", "Johannes Kowalski"), record("2", "Johanes Kowalski"), record("3", "Maria Ferrari"), record("4", None)]
    (tmp_path / "a.jsonl").write_text("\n".join(map(json.dumps, first)))
    (tmp_path / "b.jsonl").write_text("\n".join(map(json.dumps, [record("0", "Johannes Kowalsky"), record("3", "Maria Ferari")])))
    main(["load", str(tmp_path / "a.jsonl"), str(tmp_path / "l1"), "--dead", str(tmp_path / "dead")], spark)
    assert {r["record_id"]: r["entity_id"] for r in read(spark, tmp_path / "l1")} == {"S:1": "S:1", "S:2": "S:1", "S:3": "S:3"}
    assert [r["RECORD_ID"] for r in read(spark, tmp_path / "dead")] == ["4"]
    main(["load", str(tmp_path / "b.jsonl"), str(tmp_path / "l2"), "--stored", str(tmp_path / "l1")], spark)
    assert {r["record_id"]: (r["name"], r["entity_id"]) for r in read(spark, tmp_path / "l2")} == {"S:0": ("Johannes Kowalsky", "S:0"), "S:1": ("Johannes Kowalski", "S:0"), "S:2": ("Johanes Kowalski", "S:0"), "S:3": ("Maria Ferari", "S:3")}
    (tmp_path / "q.jsonl").write_text("\n".join(map(json.dumps, [{"name": "J. Kowalski", "entity": "S:0"}, {"name": "Nobody", "entity": "S:0"}])))
    main(["why", str(tmp_path / "q.jsonl"), str(tmp_path / "w"), "--entities", str(tmp_path / "l2")], spark)
    told = {r["name"]: r for r in read(spark, tmp_path / "w")}
    assert told["J. Kowalski"]["score"] == 90 and told["J. Kowalski"]["alias"] == "Johanes Kowalski" and "score" not in told["Nobody"]
