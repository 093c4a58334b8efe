import pytest
from conftest import HEADER
from pyspark.sql import functions as F

from panelloom.functions import encoding as enc
from panelloom.model import SchemaMismatchError
from panelloom.plans.ingest import ingest
from panelloom.sources.csv_scan import audit_files, scan_csv

TEXT = "Marbella Döşemelik Deri,Ayakkabılık,Çantalık,Giyimlik"


def broken(text: str) -> str:
    return text.encode("utf-8").decode("cp1252")


CASES = {
    "DÃ¶ÅŸemelik": "Döşemelik",
    "AyakkabÄ±lÄ±k": "Ayakkabılık",
    "Ã‡antalÄ±k": "Çantalık",
    "ÃœrÃ¼n": "Ürün",
    "GiriÅŸ": "Giriş",
    TEXT: TEXT,
    "plain ascii": "plain ascii",
    "ÃœrÃ¼n ş": "ÃœrÃ¼n ş",
}


def test_repair_of_single_texts(spark):
    rows = spark.createDataFrame([(k,) for k in CASES], "t string")
    got = {r["t"]: r["f"] for r in rows.select("t", enc.repair_mojibake("t").alias("f")).collect()}
    assert got == CASES


def test_every_pair_is_repaired(spark):
    letters = "öüçÇÖÜıİğĞşŞ"
    rows = spark.createDataFrame([(broken(x), x) for x in letters], "t string, x string")
    fixed = rows.select("x", enc.repair_mojibake("t").alias("f")).collect()
    assert all(r["x"] == r["f"] for r in fixed)
    assert tuple(broken(x) for x in letters) == enc.MOJIBAKE_PAIRS


def test_score(spark):
    row = spark.createDataFrame([("çÃ¶şÎ",)], "t string")
    assert row.selectExpr(f"{enc.turkish_score('t')} AS s").first()["s"] == 2 - 2 - 2


@pytest.mark.parametrize("encoding", ["utf-8", "utf-8-sig", "cp1254", "iso8859-9"])
def test_file_encodings_give_the_same_rows(spark, write_csv, encoding):
    line = "U1,Ağır Döşemelik İş,Çantalık,Ana Şube,2026-01,1,2,3,4,5"
    if encoding == "iso8859-9":
        line = line.replace("Ana", "Ana\x81")  # a byte CP1254 does not define
    path = write_csv(line, encoding=encoding if encoding != "iso8859-9" else "iso8859-9")
    audit = audit_files(spark, path).first()
    expected = "utf-8-sig" if encoding.startswith("utf") else encoding
    assert (audit["encoding"], audit["verdict"], audit["lines"]) == (expected, "clean", 2)
    scan = scan_csv(spark, path)
    assert scan.headers[0] == "stok_kodu"
    row = scan.rows.first()
    assert row["urun_adi"] == "Ağır Döşemelik İş" and row["kategori"] == "Çantalık"
    assert row["depo"].replace("\x81", "") == "Ana Şube"


def test_mixed_folder_reads_each_file_in_its_encoding(spark, write_csv, tmp_path):
    line = "{},Döşemelik,Çantalık,Şube,2026-01,1,2,3,4,5"
    write_csv(line.format("U1"), name="a.csv")
    write_csv(line.format("U2"), name="b.csv", encoding="cp1254")
    write_csv(broken(line.format("U3")), name="c.csv")
    scan = scan_csv(spark, str(tmp_path))
    got = {(r["stok_kodu"], r["urun_adi"], r["depo"]) for r in scan.rows.collect()}
    assert got == {(u, "Döşemelik", "Şube") for u in ("U1", "U2", "U3")}
    assert scan.repaired and "cp1254" in scan.encoding and "mojibake" in scan.encoding


def test_folder_with_different_headers_raises(spark, write_csv, tmp_path):
    line = "U1,n,K,D,2026-01,1,2,3,4,5"
    write_csv(line, name="a.csv")
    names = HEADER.split(",")
    write_csv(line, header=",".join([names[1], names[0], *names[2:]]), name="b.csv")
    with pytest.raises(Exception, match="header"):
        scan_csv(spark, str(tmp_path)).rows.collect()


def test_folder_with_different_headers_in_other_encodings_raises(spark, write_csv, tmp_path):
    line = "U1,n,K,Şube,2026-01,1,2,3,4,5"
    write_csv(line, name="a.csv")
    names = HEADER.split(",")
    header = ",".join([names[1], names[0], *names[2:]])
    write_csv(line, header=header, name="b.csv", encoding="cp1254")
    with pytest.raises(SchemaMismatchError, match="header"):
        scan_csv(spark, str(tmp_path))


def test_suspect_file_is_reported_next_to_a_repaired_one(spark, write_csv, tmp_path):
    line = "{},Döşemelik,Çantalık,Şube,2026-01,1,2,3,4,5"
    write_csv(broken(line.format("U1")), name="a.csv")
    write_csv(broken(line.format("U2")), line.format("U3"), name="b.csv")
    codes = {r["code"] for r in ingest(spark, str(tmp_path)).issues.collect()}
    assert {"ENCODING_REPAIRED", "ENCODING_SUSPECT"} <= codes


def test_files_with_and_without_byte_order_mark(spark, write_csv, tmp_path):
    write_csv("U1,n,K,D,2026-01,1,2,3,4,5", name="a.csv")
    write_csv("U2,n,K,D,2026-01,1,2,3,4,5", name="b.csv", encoding="utf-8-sig")
    rows = scan_csv(spark, str(tmp_path)).rows.collect()
    assert {r["stok_kodu"] for r in rows} == {"U1", "U2"}


def test_repaired_file_is_reported_with_samples(spark, write_csv):
    lines = [broken(f"U{i},Döşemelik {i},Çantalık,Şube,2026-01,1,2,3,4,5") for i in range(3)]
    outcome = ingest(spark, write_csv(*lines))
    issue = outcome.issues.filter("code = 'ENCODING_REPAIRED'").first()
    assert issue["samples"][:3] == [
        "DÃ¶ÅŸemelik 0 -> Döşemelik 0",
        "Ã‡antalÄ±k -> Çantalık",
        "Åžube -> Şube",
    ]
    assert issue["affected_rows"] == len(lines) and len(issue["samples"]) == 5
    assert outcome.report.first()["encoding_detected"].startswith("utf-8")
    assert {r["kategori"] for r in outcome.clean.collect()} == {"Çantalık"}


def test_damage_beyond_repair_is_left_and_reported(spark, write_csv):
    outcome = ingest(
        spark,
        write_csv(
            broken("U1,Döşemelik,K,D,2026-01,1,2,3,4,5"), "U2,Döşemelik,K,D,2026-01,1,2,3,4,5"
        ),
    )
    codes = {r["code"]: r["affected_rows"] for r in outcome.issues.collect()}
    assert codes["ENCODING_SUSPECT"] == 0 and "ENCODING_REPAIRED" not in codes
    names = {r["urun_adi"] for r in outcome.clean.select("urun_adi").collect()}
    assert names == {"Döşemelik", broken("Döşemelik")}


def test_line_break_inside_quotes(spark, write_csv):
    scan = scan_csv(spark, write_csv('U1,"two\nlines, ""quoted""",K,D,2026-01,1,2,3,4,5'))
    assert [r["urun_adi"] for r in scan.rows.select(F.col("urun_adi")).collect()] == [
        'two\nlines, "quoted"'
    ]


def test_pairs_in_legacy_files_are_found_without_decoding_them(spark):
    shown = [chr(i) + chr(j) for i in (0xC3, 0xC4, 0xC5, 0xD0) for j in range(0x80, 0x100)]
    rows = spark.createDataFrame([(x,) for x in shown], "t string")
    found = rows.selectExpr(
        f"{enc.has_legacy_mojibake('t')} AS quick", f"{enc.has_mojibake(enc.turkish_from_latin1('t'))} AS whole"
    ).collect()
    assert all(r["quick"] == r["whole"] for r in found) and sum(r["quick"] for r in found) == len(enc.MOJIBAKE_PAIRS)


def test_round_trip_fails_outside_of_cp1252_only(spark):
    points = [*range(1, 0x180), *(ord(c) for c in enc.CP1252_CHARS), 0x3042, 0x1F600]
    rows = spark.createDataFrame([(f"x{chr(p)}", p) for p in points], "t string, p int")

    def expected(text):
        try:
            return text.encode("cp1252").decode("utf-8")
        except UnicodeError:
            return None

    for r in rows.selectExpr("t", f"{enc.undo_cp1252('t')} AS f").collect():
        assert r["f"] == expected(r["t"]), r


def test_a_mixed_folder_parses_each_record_once(spark, tmp_path):
    for name, encoding in (("a", "utf-8"), ("b", "cp1254")):
        (tmp_path / f"{name}.csv").write_bytes("ad,donem\n\n \t\nÇağrı,2026-01\n ,\n".encode(encoding))
    (tmp_path / "c.csv").write_bytes(("\n\nad,donem\n" + broken("Çağrı") + ',"2026-01"\n').encode())
    scan = scan_csv(spark, str(tmp_path))
    assert scan.headers == ("ad", "donem") and scan.repaired
    assert [tuple(r)[:2] for r in scan.rows.collect()] == [("Çağrı", "2026-01")] * 3
    assert scan.rows._jdf.queryExecution().optimizedPlan().toString().count("from_csv") == 1
