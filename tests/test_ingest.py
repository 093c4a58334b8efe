import pytest
from conftest import HEADER, by_code

from panelloom.model import EmptyDatasetError, IngestionError, SchemaMismatchError, UnknownPackError
from panelloom.packs import campaigns, inventory
from panelloom.packs.registry import detect_pack, get_pack
from panelloom.plans.ingest import ingest, ingest_frame


def row(entity, month, inflow="10", outflow="5", stock="100", cost="1", price="2", name="n"):
    return f"{entity},{name},K,D,{month},{inflow},{outflow},{stock},{cost},{price}"


def test_messy_report(spark, write_csv):
    """One file with most defects; each must be found, counted and handled."""
    path = write_csv(
        row("U001", "2026-01"),
        row("U001", "2026-02", stock="105"),
        row("U001", "2026-02", stock="105.0"),  # exact copy: 105 and 105.0 are equal
        row("U001", "2026-03", inflow="", stock=""),  # both filled
        row("U001", "2026-04", stock="115"),
        " , ,,,,,,,,",  # blank
        row("U002", "2026-01", stock="100"),
        row("U002", "2026-01", stock="999"),  # conflict: the later one wins
        row("U003", "OCAK-26"),
        row("U004", "2026-01", inflow="abc", outflow="def", stock="ghi"),
        row("U005", "2026-01", stock="-50"),
        row("U006", "2026-01", cost="30", price="20"),
        row("U007", "2026-01", cost="10", price="20"),
        row("U007", "2026-02", cost="11.5", price="20", stock="300"),
        row("U008", "2026-01", name=""),
    )
    outcome = ingest(spark, path)
    issues = by_code(outcome)
    counts = {code: issue["affected_rows"] for code, issue in issues.items()}
    assert counts == {
        "MISSING_DETECTED": counts["MISSING_DETECTED"],
        "INVALID_PERIOD_FORMAT": 1,
        "DUPLICATE_EXACT": 1,
        "DUPLICATE_KEY": 1,
        "IMPUTED_FLOW": 1,
        "IMPUTED_STOCK": 1,
        "PERIOD_GAP": 6,
        "ROW_QUARANTINED": 2,
        "RECONCILIATION_BREAK": 1,
        "NEGATIVE_VALUE": 1,
        "MARGIN_INVERSION": 1,
        "COST_SPIKE": 1,
    }
    assert issues["INVALID_PERIOD_FORMAT"]["samples"] == ["OCAK-26"]
    assert issues["DUPLICATE_KEY"]["samples"] == ["U002 / 2026-01 (2 kayıt)"]
    assert issues["ROW_QUARANTINED"]["samples"] == ["U004 / 2026-01", "U008 / 2026-01"]
    assert issues["RECONCILIATION_BREAK"]["samples"] == ["U007 / 2026-02 / 195.00"]
    assert issues["COST_SPIKE"]["samples"] == ["U007 / 2026-02 / 15.00"]
    assert issues["PERIOD_GAP"]["samples"][0] == "U002: 1/4 dönem"
    assert "4 dönem" in issues["PERIOD_GAP"]["detail"]

    report = outcome.report.first()
    assert (report["raw_row_count"], report["clean_row_count"]) == (14, 9)
    assert report["quarantined_row_count"] == 2
    ranks = ["kritik", "yuksek", "orta", "dusuk", "bilgi"]
    order = [ranks.index(r["severity"]) for r in outcome.issues.collect()]
    assert order == sorted(order)
    assert [i["code"] for i in report["issues"]] == [r["code"] for r in outcome.issues.collect()]

    clean = {(r["stok_kodu"], r["donem"]): r for r in outcome.clean.collect()}
    assert clean["U002", "2026-01"]["donem_sonu_stok"] == 999.0
    filled = clean["U001", "2026-03"]
    assert filled["giris_miktar"] == 10.0 and filled["donem_sonu_stok"] == 110.0
    assert filled["giris_miktar__imputed"] and filled["donem_sonu_stok__imputed"]
    assert "cikis_miktar__imputed" not in outcome.clean.columns
    assert set(outcome.imputed_columns) == {"giris_miktar", "donem_sonu_stok"}


def test_conflicting_estimates_keep_the_forward_one(spark, write_csv):
    path = write_csv(
        row("U1", "2026-01", "10", "5", "100"),
        row("U1", "2026-02", "10", "5", ""),
        row("U1", "2026-03", "10", "5", "90"),
        row("U2", "2026-01", "10", "5", "100"),
        row("U2", "2026-02", "10", "5", ""),
        row("U2", "2026-03", "10", "5", ""),  # its predecessor is null: quarantined
    )
    outcome = ingest(spark, path)
    issues = by_code(outcome)
    assert issues["IMPUTATION_AMBIGUOUS"]["samples"] == ["U1 / 2026-02: ileri=105 geri=85"]
    assert issues["IMPUTED_STOCK"]["affected_rows"] == 2
    assert "uyuşmuyor" in issues["IMPUTED_STOCK"]["detail"]
    # the imputed row and the one after it are exempt from every rule
    assert "RECONCILIATION_BREAK" not in issues
    assert [(r["stok_kodu"], r["donem"]) for r in outcome.quarantined.collect()] == [("U2", "2026-03")]


def test_clean_report_scores_100(spark, write_csv):
    outcome = ingest(spark, write_csv(row("U1", "2026-01"), row("U1", "2026-02", stock="105")))
    report = outcome.report.first()
    assert report["health_score"] == 100 and report["issue_count"] == 0
    assert not report["has_blocking_issues"] and outcome.imputed_columns == ()


def test_rows_without_period_are_quarantined_unless_one_is_malformed(spark, write_csv):
    good, nothing, bad = row("U1", "2026-01"), row("U2", ""), row("U3", "x")
    outcome = ingest(spark, write_csv(good, nothing, name="a.csv"))
    assert outcome.counts["quarantined"] == 1
    outcome = ingest(spark, write_csv(good, nothing, bad, name="b.csv"))
    assert outcome.counts["quarantined"] == 0 and outcome.counts["clean"] == 1


def test_headers_aliases_and_unknown_columns(spark, write_csv):
    header = "SKU,Ürün Adı,Kategori,Ambar,Ay,Giriş,ÇIKIŞ,Son-Stok,birim.maliyet,Satış Fiyatı,Extra"
    outcome = ingest(spark, write_csv(row("U1", "2026-01") + ",x", header=header))
    assert by_code(outcome)["UNKNOWN_COLUMNS"]["samples"] == ["Extra"]
    assert outcome.clean.columns == inventory.PACK.schema.names


def test_ragged_rows(spark, write_csv):
    outcome = ingest(spark, write_csv(row("U1", "2026-01") + ",surplus", "U2,n,K,D,2026-01,1"))
    assert (outcome.counts["clean"], outcome.counts["quarantined"]) == (1, 1)


def test_errors(spark, write_csv, tmp_path):
    with pytest.raises(EmptyDatasetError):
        ingest(spark, write_csv(name="header_only.csv"), "inventory")
    (tmp_path / "empty.csv").write_bytes(b"")
    with pytest.raises(EmptyDatasetError):
        ingest(spark, str(tmp_path / "empty.csv"), "inventory")
    with pytest.raises(SchemaMismatchError) as caught:
        ingest(spark, write_csv("U1,2026-01", header="stok_kodu,donem"), "inventory")
    assert "urun_adi" in caught.value.details["missing_columns"]
    with pytest.raises(EmptyDatasetError):
        ingest(spark, write_csv("1,2", header="a,b"))
    with pytest.raises(EmptyDatasetError):
        ingest(spark, write_csv(row("U1", "2026-01", name="")), "inventory")
    with pytest.raises(UnknownPackError):
        ingest(spark, write_csv(row("U1", "2026-01")), "nope")
    with pytest.raises(IngestionError):
        ingest(spark, str(tmp_path / "missing.csv"), "inventory")


def test_pack_detection():
    assert detect_pack(HEADER.split(",")) is inventory.PACK
    assert detect_pack([c.upper() for c in campaigns.PACK.schema.names]) is campaigns.PACK
    assert detect_pack(["a"]) is None
    assert get_pack("campaigns") is campaigns.PACK
    # a repeated header stays unmapped and is told
    match = inventory.PACK.match_headers([*HEADER.split(","), "SKU", "x"])
    assert match.unused == ["x", "SKU"] and match.unknown == ["x"] and match.repeated == ["SKU"]
    assert len(match.columns) == 10 and not match.missing


def test_frame_input_uses_the_given_order(spark):
    names = [*HEADER.split(","), "n"]
    first = row("U1", "2026-01", stock="1").split(",")
    second = row("U1", "2026-01", stock="2").split(",")
    rows = spark.createDataFrame(
        [(*second, 2), (*first, 1)], ", ".join(f"{c} string" for c in names[:-1]) + ", n int"
    ).repartition(2)
    outcome = ingest_frame(rows, inventory.PACK, "n")
    assert [r["donem_sonu_stok"] for r in outcome.clean.collect()] == [2.0]


def test_a_hot_key_is_reduced_before_the_shuffle(spark):
    """A third of all rows under one key, all different: the last one is kept."""
    from pyspark.sql import functions as F

    base = spark.range(30000).select(
        F.when(F.col("id") % 3 == 0, "HOT").otherwise(F.concat(F.lit("U"), "id")).alias("stok_kodu"),
        F.lit("n").alias("urun_adi"), F.lit("K").alias("kategori"), F.lit("D").alias("depo"),
        F.lit("2026-01").alias("donem"), F.lit("1").alias("giris_miktar"),
        F.lit("1").alias("cikis_miktar"), F.col("id").cast("string").alias("donem_sonu_stok"),
        F.lit("1").alias("birim_maliyet_tl"), F.lit("2").alias("birim_satis_tl"), "id",
    )
    outcome = ingest_frame(base, inventory.PACK, "id")
    assert outcome.counts["key_removed"] == 9999 and outcome.counts["clean"] == 20001
    hot = outcome.clean.filter("stok_kodu = 'HOT'").collect()
    assert [r["donem_sonu_stok"] for r in hot] == [29997.0]
