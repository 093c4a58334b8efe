import pytest
from pyspark.sql import functions as F

from panelloom.operators import deltas, risks, summaries
from panelloom.operators.series import build_series
from panelloom.pack import Stage
from panelloom.packs import campaigns, inventory
from panelloom.plans import results
from panelloom.plans.analyze import analyze

PACK = inventory.PACK
MONTHS = [f"2026-{m:02d}" for m in range(1, 7)]


def product(key, stocks, outflows, cost=(10,) * 6, price=(20,) * 6, inflow=None, kind="K", place="D"):
    inflow = inflow or outflows
    return [
        (key, f"item {key}", kind, place, m, float(i), float(o), float(s), float(c), float(p))
        for m, i, o, s, c, p in zip(MONTHS, inflow, outflows, stocks, cost, price)
    ]


ROWS = [
    *product("OUT", (50, 0, 0, 0, 0, 0), (100, 90, 80, 80, 80, 60)),
    *product("SOON", (50, 45, 40, 35, 30, 25), (40,) * 6),
    *product("DEAD", (500,) * 6, (10,) * 6),
    *product("SLOW", (80,) * 6, (10,) * 6, kind="K2"),
    *product("ERODE", (150,) * 6, (50,) * 6, cost=(10, 10, 11, 13, 13, 13)),
    *product("GROW", (300, 310, 320, 330, 340, 350), (100,) * 6, inflow=(110,) * 6),
    *product("SURGE", (300,) * 6, (50, 50, 50, 90, 100, 110), place="D2"),
    *product("PEAK", (300,) * 6, (100, 100, 190, 100, 100, 100)),
    *product("FADE", (40,) * 6, (15, 14, 13, 12, 11, 10)),
]


@pytest.fixture(scope="module")
def result(spark):
    return analyze(spark.createDataFrame(ROWS, PACK.schema), PACK)


@pytest.fixture(scope="module")
def found(result):
    return {(r["code"], r["entity"]): r for r in result.risks.collect()}


def test_risk_codes(found):
    expected = {
        ("STOCKOUT", "OUT"), ("STOCKOUT_IMMINENT", "SOON"), ("DEAD_STOCK", "DEAD"),
        ("SLOW_MOVER", "SLOW"), ("MARGIN_EROSION", "ERODE"), ("COST_SHOCK", "ERODE"),
        ("SILENT_ACCUMULATION", "GROW"), ("DEMAND_SURGE", "SURGE"), ("SEASONAL_PEAK", "PEAK"),
        ("DYING_SKU", "FADE"),
    }
    assert set(found) == expected


def test_impacts_and_onsets(found):
    assert found["STOCKOUT", "OUT"]["financial_impact_tl"] == (100 - 60) * 5 * 20
    assert found["STOCKOUT", "OUT"]["first_seen_period"] == "2026-02"
    assert found["STOCKOUT_IMMINENT", "SOON"]["financial_impact_tl"] == 800
    assert found["STOCKOUT_IMMINENT", "SOON"]["first_seen_period"] == "2026-01"
    assert found["DEAD_STOCK", "DEAD"]["financial_impact_tl"] == 5000
    assert found["SLOW_MOVER", "SLOW"]["financial_impact_tl"] == 400
    assert found["MARGIN_EROSION", "ERODE"]["financial_impact_tl"] == pytest.approx(150)
    assert found["MARGIN_EROSION", "ERODE"]["first_seen_period"] == "2026-03"
    assert found["COST_SHOCK", "ERODE"]["financial_impact_tl"] is None
    assert found["COST_SHOCK", "ERODE"]["first_seen_period"] == "2026-04"
    assert found["SILENT_ACCUMULATION", "GROW"]["financial_impact_tl"] == 10 * 6 * 10
    assert found["SILENT_ACCUMULATION", "GROW"]["first_seen_period"] is None
    assert found["DEMAND_SURGE", "SURGE"]["financial_impact_tl"] == 50 * 20
    assert found["DEMAND_SURGE", "SURGE"]["first_seen_period"] == "2026-04"
    assert found["SEASONAL_PEAK", "PEAK"]["first_seen_period"] == "2026-03"
    assert found["DYING_SKU", "FADE"]["financial_impact_tl"] == 400


def test_risk_texts(found):
    out = found["STOCKOUT", "OUT"]
    assert out["narrative"].startswith("5 dönemdir stok sıfır. Bu dönemlerin 5 tanesinde")
    assert "100 adetken şimdi 60 adete" in out["narrative"]
    assert "5.000 TL sermaye" in found["DEAD_STOCK", "DEAD"]["narrative"]
    assert out["entity_label"] == "item OUT"
    assert out["dimensions"] == {"kategori": "K", "depo": "D"}
    assert [e["metric"] for e in out["evidence"]][:2] == ["son_stok", "sifir_stok_donem"]
    assert out["evidence"][0]["label"] == "Son Stok" and out["evidence"][0]["unit"] == "adet"
    surge = found["DEMAND_SURGE", "SURGE"]
    assert "ortalama 50 adetken son 3 ayda 100 adete" in surge["narrative"]


def test_risk_order_and_filters(result):
    ordered = risks.ordered_risks(result.risks).collect()
    assert [r["code"] for r in ordered[:2]] == ["STOCKOUT", "MARGIN_EROSION"]
    assert ordered[-1]["code"] == "SEASONAL_PEAK"
    assert [r["code"] for r in risks.top_risks(result.risks, 3).collect()] == [
        r["code"] for r in ordered[:3]
    ]
    with pytest.raises(ValueError):
        risks.top_risks(result.risks, 0)
    assert risks.top_risks(result.risks, 51).count() == result.risks.count()
    tables = results.risk_tables(result, severity="yuksek", period="2026-01")
    assert tables["totals"].first()["total"] == 2
    assert {r["code"] for r in tables["by_code"].collect()} == {"STOCKOUT_IMMINENT", "DEAD_STOCK"}


def test_prioritised_entities_keep_risky_ones(result):
    top = risks.prioritised_entities(result.entity_rows, PACK, 9).collect()
    assert all(r["risky"] for r in top)


def test_a_cover_without_movement_is_not_dead_stock(spark):
    panel = spark.createDataFrame(product("STILL", (900,) * 6, (0,) * 6), PACK.schema)
    entities = summaries.entity_summary(build_series(panel, PACK), PACK)
    assert entities.first()["son_kapama_ay"] is None
    assert risks.risk_table(entities, PACK).count() == 0


def test_movers(spark):
    rows = [
        *product("A", (9,) * 6, (10, 30, 30, 30, 30, 30)),
        *product("B", (9,) * 6, (10, 20, 5, 5, 5, 5)),
        *product("C", (9,) * 6, (10, 15, 15, 15, 15, 15)),
        *product("E", (9,) * 6, (10, 11, 11, 11, 11, 11)),
    ]
    # D skips February: its change in March is against no neighbour
    rows += [r for r in product("D", (9,) * 6, (10, 0, 90, 90, 90, 90)) if r[4] != "2026-02"]
    # F is renamed in March
    rows += [
        (*r[:1], "renamed" if r[4] >= "2026-03" else r[1], *r[2:])
        for r in product("F", (9,) * 6, (10, 10, 80, 81, 81, 81))
    ]
    series = build_series(spark.createDataFrame(rows, PACK.schema), PACK)
    moved = deltas.top_movers(series, PACK).collect()
    got = {(r["period"], r["direction"], r["rank"]): (r["entity"], r["change"]) for r in moved}
    assert got == {
        ("2026-02", "up", 1): ("A", 20.0),
        ("2026-02", "up", 2): ("B", 10.0),
        ("2026-02", "up", 3): ("C", 5.0),
        ("2026-03", "down", 1): ("B", -15.0),
        ("2026-04", "up", 1): ("F", 1.0),
    }


def test_deltas(result):
    rows = {r["period"]: r for r in result.deltas.collect()}
    assert rows["2026-01"]["previous_period"] is None and not rows["2026-01"]["movers_up"]
    assert rows["2026-03"]["previous_period"] == "2026-02"
    up = rows["2026-03"]["movers_up"][0]
    assert (up["entity"], up["value"], up["metric"]) == ("PEAK", 90.0, "cikis_miktar_change")
    assert up["label"] == "Çıkış değişimi" and up["period"] == "2026-03"
    assert rows["2026-03"]["new_risks"] == ["MARGIN_EROSION", "SEASONAL_PEAK"]
    assert all(r["resolved_risks"] == [] for r in rows.values())
    assert len(rows["2026-01"]["metrics"]) == 8


def test_period_and_dimension_rows(result):
    first = result.period_rows.orderBy("donem").first()
    assert first["toplam_ciro_tl"] == 20 * (100 + 40 + 10 + 10 + 50 + 100 + 50 + 100 + 15)
    assert first["toplam_ciro_tl_delta"] is None and first["tukenen_urun_sayisi"] == 0
    dims = result.dimension_rows.collect()
    assert {(r["dimension"], r["dimension_value"]) for r in dims} == {
        ("kategori", "K"), ("kategori", "K2"), ("depo", "D"), ("depo", "D2"),
    }
    counts = {(r["dimension_value"], r["donem"]): r["urun_sayisi"] for r in dims}
    assert counts["K", "2026-01"] == 8 and counts["D2", "2026-06"] == 1


def test_headline_and_snapshot(result):
    values = {r["metric"]: r["value"] for r in result.headline.collect()}
    assert set(values) == set(inventory.HEADLINE) and values["tukenen_urun_sayisi"] == 1
    pair = deltas.snapshot_pair(result.series, PACK, "2026-03")
    assert {(r["scope"], r["period"]) for r in pair.collect()} == {
        ("current", "2026-03"), ("previous", "2026-02"),
    }


def test_result_tables(spark, result, tmp_path):
    view = results.overview(result, top=2)
    assert view["top_risks"].count() == 2 and view["entity_count"].first()[0] == 9
    columns = [r["name"] for r in results.entity_columns(spark, PACK).orderBy("position").collect()]
    assert columns[:4] == ["stok_kodu", "urun_adi", "kategori", "depo"]
    assert "zirve_donem" not in columns and "son_stok" in columns
    assert "series_rows" not in results.entity_tables(result, include_series=False)
    path = str(tmp_path / "series")
    results.write_series(result, path)
    back = spark.read.parquet(path)
    assert back.count() == len(ROWS)
    assert back.filter(F.col("donem") == "2026-03").count() == 9


def test_unusable_rule_is_skipped_and_logged(spark, caplog):
    from dataclasses import replace

    broken = replace(PACK.found_at(Stage.WINDOW)[0], code="BROKEN", holds=lambda p: F.col("no_such_column") > 0)
    pack = replace(PACK, conditions=(broken, *PACK.conditions))
    from panelloom.operators.quality import violation_columns, with_violations

    series = build_series(spark.createDataFrame(ROWS, PACK.schema), PACK)
    assert "__bad_BROKEN" not in violation_columns(with_violations(series, pack))
    assert "BROKEN" in caplog.text

    lost = replace(PACK.found_at(Stage.ENTITY)[0], code="LOST", holds=lambda p: F.col("no_such_column") > 0)
    entities = summaries.entity_summary(series, PACK)
    table = risks.risk_table(entities, replace(PACK, conditions=(lost, *PACK.conditions)))
    assert table.count() == 10 and "LOST" in caplog.text


def test_trend_column_falls_back_to_the_first_measure():
    from dataclasses import replace

    assert replace(PACK, trend="").trend_column == "giris_miktar"
    assert campaigns.PACK.trend_column == "harcama_tl"
