"""Known results of the three sample exports, if a folder with them is given.

Set REPORT_SAMPLES to a folder holding the inventory export, the same export with
broken encoding, and the campaign export; the files are told apart by content.
"""

import glob
import os

import pytest

from panelloom.plans.analyze import analyze_ingested
from panelloom.plans.ingest import ingest
from panelloom.operators.risks import ordered_risks

FOLDER = os.environ.get("REPORT_SAMPLES", "")
FILES = sorted(glob.glob(os.path.join(FOLDER, "*.csv"))) if FOLDER else []
pytestmark = pytest.mark.skipif(not FILES, reason="REPORT_SAMPLES is not set")

INVENTORY_RISKS = {
    ("STOCKOUT", "U005", 33480, "2026-02"), ("STOCKOUT", "U003", 10680, "2026-04"),
    ("STOCKOUT_IMMINENT", "U007", 5040, "2026-01"), ("STOCKOUT_IMMINENT", "U013", 12740, "2026-05"),
    ("DEAD_STOCK", "U004", 36270, "2026-01"), ("SLOW_MOVER", "U001", 45920, "2026-01"),
    ("SLOW_MOVER", "U009", 50820, "2026-01"), ("SLOW_MOVER", "U010", 20800, "2026-01"),
    ("MARGIN_EROSION", "U007", 572, "2026-03"), ("COST_SHOCK", "U007", None, "2026-03"),
    ("SILENT_ACCUMULATION", "U002", 5280, None), ("SILENT_ACCUMULATION", "U008", 1560, None),
    ("SILENT_ACCUMULATION", "U010", 768, None), ("SILENT_ACCUMULATION", "U012", 1140, None),
    ("DEMAND_SURGE", "U011", 4213.33, "2026-04"), ("SEASONAL_PEAK", "U006", None, "2026-04"),
    ("SEASONAL_PEAK", "U011", None, "2026-05"), ("DYING_SKU", "U014", 490, None),
}
CAMPAIGN_RISKS = {
    ("AD_FATIGUE", "K006", 4801, "2026-04"), ("AD_FATIGUE", "K011", 5043, "2026-03"),
    ("SCALING_INEFFICIENCY", "K006", 6240, "2026-01"),
    ("UNPROFITABLE", "K006", 13631, "2026-01"), ("UNPROFITABLE", "K011", 12070, "2026-02"),
    ("STAR_SCALE_UP", "K001", 3723, None), ("STAR_SCALE_UP", "K005", 4968, None),
    ("STAR_SCALE_UP", "K007", 963.9, None), ("STAR_SCALE_UP", "K008", 1836, None),
    ("EFFICIENT_GROWTH", "K001", None, None),
    *((("LOW_CONVERSION", k, None, None)) for k in ("K004", "K006", "K011", "K013", "K015")),
}
REVENUE = {"2026-01": 174810, "2026-02": 169794, "2026-03": 174254, "2026-04": 175366,
           "2026-05": 176208, "2026-06": 168696}
SPEND = {"2026-01": 34524, "2026-02": 37079, "2026-03": 39540, "2026-04": 42500,
         "2026-05": 46434, "2026-06": 49594}


def found_risks(result):
    rows = ordered_risks(result.risks).collect()
    return {
        (r["code"], r["entity"], r["financial_impact_tl"] and round(r["financial_impact_tl"], 2),
         r["first_seen_period"])
        for r in rows
    }


@pytest.mark.parametrize("path", FILES)
def test_sample(spark, path):
    outcome = ingest(spark, path)
    result = analyze_ingested(outcome)
    report = outcome.report.first()
    assert (report["raw_row_count"], report["clean_row_count"]) == (91, 90)
    assert report["quarantined_row_count"] == 0
    periods = {r["donem"]: r for r in result.period_rows.collect()}
    if outcome.pack.key == "campaigns":
        assert found_risks(result) == CAMPAIGN_RISKS
        assert {k: r["toplam_harcama_tl"] for k, r in periods.items()} == SPEND
        filled = outcome.clean.filter("kampanya_id = 'K009' AND donem = '2026-03'").first()
        names = ("harcama_tl", "gosterim", "tiklama", "frekans", "donusum", "gelir_tl")
        assert [filled[n] for n in names] == [2040, 86700, 1300, 2.2, 40, 6120]
        return
    assert report["health_score"] == (67 if report["encoding_repaired"] else 69)
    assert found_risks(result) == INVENTORY_RISKS
    assert {k: r["toplam_ciro_tl"] for k, r in periods.items()} == REVENUE
    kinds = {r["kategori"] for r in outcome.clean.select("kategori").distinct().collect()}
    assert kinds == {"Giyimlik", "Döşemelik", "Ayakkabılık", "Çantalık"}
    series = {(r["stok_kodu"], r["donem"]): r for r in result.series.collect()}
    assert series["U010", "2026-05"]["mutabakat_farki"] == -20
    assert series["U010", "2026-04"]["donem_sonu_stok"] == 5180
    assert round(series["U004", "2026-06"]["kapama_ay"], 2) == 13.66
    assert round(series["U007", "2026-01"]["marj_yuzde"], 3) == 42.857
    movers = {r["period"]: r for r in result.deltas.collect()}["2026-03"]["movers_up"]
    assert [(m["entity"], m["value"]) for m in movers] == [("U006", 92), ("U011", 9)]
