import json

import pytest
from test_analysis import PACK, ROWS

from panelloom.operators import grounding
from panelloom.operators.call_log import run_statistics
from panelloom.plans.analyze import analyze

CLAIM = "claim_id string, metric string, entity string, period string, value double"


@pytest.fixture(scope="module")
def facts(spark):
    rows = [
        (r[0], r[1], "Döşemelik" if r[2] == "K2" else r[2], *r[3:]) for r in ROWS
    ]
    return grounding.fact_index(analyze(spark.createDataFrame(rows, PACK.schema), PACK)).cache()


def checked(spark, facts, *claims):
    frame = spark.createDataFrame(list(claims), CLAIM)
    return {r["claim_id"]: r for r in grounding.verify(frame, facts).collect()}


def test_ladder_tolerance_and_verdicts(spark, facts):
    got = checked(
        spark,
        facts,
        ("exact", "son_stok", "DEAD", None, 500.0),
        ("rounded", "son_stok", "dead ", None, 500.4),
        ("two percent", "son_stok", "DEAD", None, 509.0),
        ("wrong", "son_stok", "DEAD", None, 99999.0),
        ("unknown metric", "magic", None, None, 42.0),
        ("period of an entity figure is dropped", "son_stok", "DEAD", "2026-02", 500.0),
        ("series", "cikis_miktar", "PEAK", "2026-03", 190.0),
        ("month", "toplam_cikis", None, "2026-01", 475.0),
        ("last month", "toplam_cikis", None, None, 490.0),
        ("unknown entity falls to the portfolio", "toplam_cikis", "nobody", "2026-01", 475.0),
        ("dimension", "toplam_ciro_tl", "Döşemelik", "2026-03", 200.0),
        ("folded dimension", "toplam_ciro_tl", "dosemelik", "2026-03", 200.0),
        ("mover", "cikis_miktar_change", "PEAK", "2026-03", 90.0),
        ("mover without month", "cikis_miktar_change", "PEAK", None, -90.0),
        ("impact", "financial_impact_tl", "DEAD", None, 5000.0),
        ("count", "periods_count", "DEAD", None, 6.0),
    )
    failed = {k for k, r in got.items() if not r["verified"]}
    assert failed == {"wrong", "unknown metric"}
    assert got["wrong"]["expected"] == 500.0 and got["wrong"]["reason"] == grounding.DEVIATES
    assert got["unknown metric"]["expected"] is None
    assert got["unknown metric"]["reason"] == grounding.NOT_FOUND
    assert got["last month"]["expected"] == 490.0


def test_restricting_to_claimed_entities_changes_nothing(spark):
    result = analyze(spark.createDataFrame(ROWS, PACK.schema), PACK)
    claims = spark.createDataFrame(
        [("a", "son_stok", "DEAD", None, 500.0), ("b", "toplam_cikis", None, "2026-01", 1.0)], CLAIM
    )
    narrow = grounding.verify(claims, grounding.written_facts(result, claims)).collect()
    full = grounding.verify(claims, grounding.fact_index(result)).collect()
    assert sorted(narrow) == sorted(full)


def test_only_figures_of_claimed_metrics_go_on(spark):
    result = analyze(spark.createDataFrame(ROWS, PACK.schema), PACK)
    claims = spark.createDataFrame(
        [("a", "son_stok", "DEAD", None, 500.0), ("b", "cikis_miktar", "DEAD", "2026-01", 1.0), ("c", None, "DEAD", None, 1.0)],
        CLAIM,
    )
    written = grounding.written_facts(result, claims).filter("written.source IN (2, 4)")
    assert {r["metric"] for r in written.select("metric").distinct().collect()} == {"son_stok", "cikis_miktar"}


def test_ladder_with_repeated_facts_and_missing_parts(spark):
    rows = [
        ("m", "e", "p", 1.0, 1), ("m", "e", "p", 2.0, 2), ("m", "e", "p", None, 3), ("m", "e", None, 3.0, 1),
        ("m", None, "p", 4.0, 1), ("m", None, None, 5.0, 1), ("n", None, "p", 6.0, 1), (None, "e", "p", 7.0, 1),
    ]
    facts = spark.createDataFrame(rows, "metric string, entity string, period string, value double, written int")
    claims = [
        ("m", "E ", "p", 2.0), ("m", "e", "q", 3.0), ("m", "e", None, 3.0), ("m", "x", "p", 4.0), ("m", "x", "q", 5.0),
        ("m", None, "p", 4.0), ("m", None, "q", 5.0), ("m", None, None, 5.0), ("n", "x", "q", None), ("n", "x", "p", 6.0),
        ("n", None, None, None), (None, "e", "p", None),
    ]
    named = [(str(i), m, e, p, 0.0) for i, (m, e, p, _) in enumerate(claims)]
    got = grounding.look_up(spark.createDataFrame(named, CLAIM), facts).collect()
    assert {r["claim_id"]: r["expected"] for r in got} == {str(i): c[3] for i, c in enumerate(claims)}


def test_repeated_claims_all_count(spark, facts):
    row = ("a", "son_stok", "DEAD", None, 500.0)
    claims = spark.createDataFrame([row] * 3 + [("a", "magic", None, None, 1.0)] * 2, CLAIM)
    got = grounding.verify(claims, facts).collect()
    assert sorted(r["verified"] for r in got) == [False, False, True, True, True]
    assert grounding.grounding_report(grounding.verify(claims, facts)).first()["total_evidence"] == 5


def test_last_risk_in_order_gives_the_impact(spark):
    # two risks of one entity: the later one in the risk order is the fact
    result = analyze(spark.createDataFrame(ROWS, PACK.schema), PACK)
    rows = grounding.risk_facts(result)[0].filter("entity = 'ERODE' AND value IS NOT NULL")
    assert [r["value"] for r in rows.collect()] == pytest.approx([150.0])


def test_report(spark, facts):
    none = spark.createDataFrame([], CLAIM)
    report = grounding.grounding_report(grounding.verify(none, facts)).first()
    assert report["grounding_ratio"] == 1.0 and report["is_acceptable"] and report["issues"] == []
    many = [(f"c{i:02d}", "son_stok", "DEAD", None, 1.0 if i < 25 else 500.0) for i in range(75)]
    report = grounding.grounding_report(
        grounding.verify(spark.createDataFrame(many, CLAIM), facts)
    ).first()
    assert (report["total_evidence"], report["verified_evidence"]) == (75, 50)
    assert report["grounding_ratio"] == 0.6667 and not report["is_acceptable"]
    assert [i["claim_id"] for i in report["issues"]] == [f"c{i:02d}" for i in range(20)]


def test_evidence_of_documents(spark):
    def item(metric):
        return {"metric": metric, "value": 1, "unit": "adet"}

    period = {"period": "2026-01", "actions": [
        {"title": "a", "evidence": [item("m1"), item("m2")]}, {"title": "bare", "evidence": []},
    ]}
    summary = {
        "strategic_actions": [{"title": "s", "evidence": [item("m5")]}],
        "top_risks": [{"title": "r", "evidence": [item("m3")]}, {"title": "none"}],
        "opportunities": [{"title": "o", "evidence": [item("m4")]}],
    }
    answer = {"answer": "x", "evidence": [item("m6")]}
    docs = spark.createDataFrame(
        [(1, json.dumps(period)), (2, json.dumps(summary)), (3, json.dumps(answer))],
        "doc int, payload string",
    )
    found = grounding.collect_evidence(docs, "doc", "payload").orderBy("doc", "pos").collect()
    assert [r["metric"] for r in found] == ["m1", "m2", "m3", "m4", "m5", "m6"]
    bare = grounding.without_evidence(docs, "doc", "payload").collect()
    assert {(r["doc"], r["part"], r["title"]) for r in bare} == {
        (1, "actions", "bare"), (2, "top_risks", "none"),
    }


def test_call_log(spark):
    calls = spark.createDataFrame(
        [
            ("r1", "big", 1000, 100, 10, 0, 5),
            ("r1", "small", 1000, 100, 0, 500, 7),
            ("r2", "unlisted", 1000, 100, 0, 0, 1),
        ],
        "run string, model string, input_tokens bigint, output_tokens bigint, "
        "cache_write_tokens bigint, cache_read_tokens bigint, duration_ms bigint",
    )
    rows = {r["run"]: r for r in run_statistics(calls, {"big": (4, 20), "small": (1, 5)}).collect()}
    one = rows["r1"]
    assert (one["call_count"], one["input_tokens"], one["cache_hit_calls"]) == (2, 2000, 1)
    big, small = 1000 * 4 + 100 * 20 + 10 * 5.0, 1000 * 1 + 100 * 5 + 500 * 0.1
    assert one["total_cost_usd"] == round((big + small) / 1e6, 5) and one["duration_ms"] == 12
    assert rows["r2"]["total_cost_usd"] == round((1000 * 5 + 100 * 25) / 1e6, 5)


def test_each_document_gets_its_report(spark):
    result = analyze(spark.createDataFrame(ROWS, PACK.schema), PACK)
    entity = result.entity_rows.select(PACK.entity, "son_stok").first()
    facts = grounding.written_facts(result)
    right = f'{{"metric": "son_stok", "value": {entity[1]}, "unit": "adet", "entity": "{entity[0]}"}}'
    wrong = f'{{"metric": "son_stok", "value": {entity[1] + 999}, "unit": "adet", "entity": "{entity[0]}"}}'
    bogus = '{"metric": "made_up", "value": 1, "unit": "adet"}'
    payloads = [
        ("good", f'{{"actions": [{{"title": "a", "evidence": [{right}]}}], "evidence": [{right}]}}'),
        ("bad", f'{{"actions": [{{"title": "a", "evidence": [{right}, {wrong}]}}], "top_risks": [{{"evidence": [{bogus}]}}]}}'),
        ("bare", '{"actions": []}'), ("broken", "no json"), ("null", None), (None, f'{{"evidence": [{wrong}]}}'),
        ("many", f'{{"evidence": [{", ".join([bogus] * 50)}]}}'),
    ]
    docs = spark.createDataFrame(payloads, "doc string, payload string")
    got = {r["doc"]: r for r in grounding.document_reports(docs, "doc", "payload", facts).collect()}
    assert len(got) == 7
    assert (got["good"]["total_evidence"], got["good"]["verified_evidence"], got["good"]["is_acceptable"]) == (2, 2, True)
    assert got["bad"]["grounding_ratio"] == 0.3333 and not got["bad"]["is_acceptable"]
    assert [i["reason"] for i in got["bad"]["issues"]] == [grounding.DEVIATES, grounding.NOT_FOUND]
    for doc in ("bare", "broken", "null"):
        assert tuple(got[doc])[1:5] == (0, 0, 1.0, True) and got[doc]["issues"] == []
    assert got[None]["total_evidence"] == 1 and not got[None]["is_acceptable"]
    assert got["many"]["total_evidence"] == 50 and len(got["many"]["issues"]) == 20
