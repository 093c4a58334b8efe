import math

from pyspark.sql import functions as F

from panelloom.functions.panel import Panel
from panelloom.operators.series import build_series, public_columns
from panelloom.operators.summaries import entity_summary
from panelloom.packs import campaigns, inventory

P = Panel("e", "p", "l")


def change(spark, *values):
    rows = [("a", f"2026-{i:02d}", v) for i, v in enumerate(values, 1)]
    frame = spark.createDataFrame(rows, "e string, p string, x double")
    shown = frame.withColumn("c", P.percent_change(F.col("x"))).orderBy("p").collect()
    return [r["c"] for r in shown]


def test_percent_change_carries_nulls_forward(spark):
    got = change(spark, 10.0, 11.0, 12.0, None, 12.0)
    assert got[0] is None
    assert [round(x, 4) for x in got[1:]] == [10.0, 9.0909, 0.0, 0.0]


def test_percent_change_from_zero(spark):
    got = change(spark, 0.0, 5.0, 0.0, 0.0, -1.0)
    assert got[0] is None and got[1] == math.inf and got[2] == -100.0
    assert math.isnan(got[3]) and got[4] == -math.inf


def inventory_panel(spark, *rows):
    """(entity, month, inflow, outflow, stock, cost, price) rows as a clean panel."""
    full = [
        (e, f"item {e}", "K", "D", m, float(i), float(o), float(s), float(c), float(x))
        for e, m, i, o, s, c, x in rows
    ]
    return spark.createDataFrame(full, inventory.PACK.schema)


def test_no_leak_between_entities(spark):
    panel = inventory_panel(
        spark,
        ("U001", "2026-01", 10, 5, 100, 1, 2),
        ("U001", "2026-02", 10, 5, 100, 1, 2),
        ("U002", "2026-01", 10, 5, 555, 1, 2),
        ("U002", "2026-02", 10, 5, 555, 1, 2),
    )
    rows = {
        (r["stok_kodu"], r["donem"]): r["onceki_stok"]
        for r in build_series(panel, inventory.PACK).collect()
    }
    assert rows["U002", "2026-01"] is None and rows["U001", "2026-01"] is None
    assert rows["U002", "2026-02"] == 555.0


def test_single_row_entity(spark):
    panel = inventory_panel(spark, ("U001", "2026-01", 10, 5, 100, 1, 2))
    row = entity_summary(build_series(panel, inventory.PACK), inventory.PACK).first()
    assert row["trend_step"] == 0.0 and row["stok_trend_step"] == 0.0
    assert row["trend_delta_pct"] == 0.0 and row["periods_count"] == 1


def test_cost_from_zero_still_counts_as_a_shock(spark):
    panel = inventory_panel(
        spark, ("U1", "2026-01", 1, 1, 5, 0, 2), ("U1", "2026-02", 1, 1, 5, 1, 2)
    )
    series = build_series(panel, inventory.PACK)
    assert entity_summary(series, inventory.PACK).first()["maliyet_sok_donem"] == "2026-02"


def test_peak_tie_takes_the_earliest_month(spark):
    panel = inventory_panel(
        spark,
        ("U1", "2026-01", 1, 3, 5, 1, 2),
        ("U1", "2026-02", 1, 9, 5, 1, 2),
        ("U1", "2026-03", 1, 9, 5, 1, 2),
        ("U1", "2026-04", 1, 2, 5, 1, 2),
    )
    row = entity_summary(build_series(panel, inventory.PACK), inventory.PACK).first()
    assert row["zirve_donem"] == "2026-02" and row["ilk3_cikis_ort"] == 7.0
    assert round(row["son3_cikis_ort"], 4) == 6.6667


def test_label_and_dimensions_come_from_the_last_row(spark):
    rows = [
        ("U1", "old", "K1", "D1", "2026-01", 1.0, 1.0, 5.0, 1.0, 2.0),
        ("U1", "new", "K2", "D2", "2026-02", 1.0, 1.0, 5.0, 1.0, 2.0),
    ]
    panel = spark.createDataFrame(rows, inventory.PACK.schema)
    row = entity_summary(build_series(panel, inventory.PACK), inventory.PACK).first()
    assert (row["urun_adi"], row["kategori"], row["depo"]) == ("new", "K2", "D2")


def test_null_ratio_in_last_row_stays_null(spark):
    rows = [
        ("K1", "c", "I", "M", "2026-01", 100.0, 10.0, 5.0, 1.0, 1.0, 200.0),
        ("K1", "c", "I", "M", "2026-02", 0.0, 10.0, 5.0, 1.0, 1.0, 200.0),
        ("K1", "c", "I", "M", "2026-03", 0.0, 10.0, 5.0, 1.0, 0.0, 200.0),
    ]
    panel = spark.createDataFrame(
        rows,
        "kampanya_id string, kampanya_adi string, platform string, urun_kategorisi string, "
        "donem string, harcama_tl double, gosterim double, tiklama double, frekans double, "
        "donusum double, gelir_tl double",
    )
    series = build_series(panel, campaigns.PACK)
    row = entity_summary(series, campaigns.PACK).first()
    assert row["ilk_roas"] == 2.0 and row["son_roas"] is None and row["son_cpa"] is None
    assert row["roas_degisim_yuzde"] is None and row["ilk_cpa"] == 100.0
    assert not [c for c in public_columns(series).columns if c.startswith("__")]
