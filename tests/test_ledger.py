import hashlib

from conftest import HEADER

from panelloom.plans.ingest import ingest
from panelloom.plans.results import pack_catalogue, record_dataset
from panelloom.sources import ledger


def test_record_list_look_up_delete(spark, write_csv, tmp_path):
    path = write_csv("U1,n,K,D,2026-01,1,1,5,1,2")
    store = str(tmp_path / "ledger")
    first = record_dataset(ingest(spark, path), path, "report.csv", store)
    second = record_dataset(ingest(spark, path), path, "again.csv", store)
    assert [r["dataset_id"] for r in ledger.newest(spark, store).collect()] == [second, first]
    digest = hashlib.sha256(open(path, "rb").read()).hexdigest()
    found = ledger.by_hash(spark, store, digest, "inventory").collect()
    assert {r["dataset_id"] for r in found} == {first, second}
    assert found[0]["raw_row_count"] == 1 and '"health_score":100' in found[0]["quality_json"]
    assert ledger.by_hash(spark, store, digest, "campaigns").count() == 0

    ledger.delete(spark.createDataFrame([(first,)], "dataset_id string"), store)
    assert [r["dataset_id"] for r in ledger.read(spark, store).collect()] == [second]
    cache = spark.createDataFrame([(first, "x"), (second, "y")], "dataset_id string, payload string")
    kept = ledger.without_deleted(cache, ledger.read(spark, store))
    assert [r["payload"] for r in kept.collect()] == ["y"]


def test_only_new_files_are_ingested(spark, tmp_path):
    store = str(tmp_path / "ledger")
    known = spark.createDataFrame([("d1", "h1", "inventory")], "dataset_id string, content_hash string, pack_key string")
    ledger.append(known, store)
    candidates = spark.createDataFrame(
        [("h1", "inventory"), ("h1", "campaigns"), ("h2", "inventory")],
        "content_hash string, pack_key string",
    )
    fresh = ledger.not_ingested(candidates, ledger.read(spark, store)).collect()
    assert {tuple(r) for r in fresh} == {("h1", "campaigns"), ("h2", "inventory")}


def test_hash_of_many_files_does_not_depend_on_order(spark, tmp_path):
    for name, text in (("a", HEADER), ("b", "x"), ("c", "x")):
        (tmp_path / name).write_text(text)
    hashes = ledger.content_hash(spark, str(tmp_path))
    one = ledger.dataset_hash(hashes).first()
    other = ledger.dataset_hash(hashes.orderBy("path", ascending=False)).first()
    assert one == other and one["files"] == 3
    assert one["content_hash"] != ledger.dataset_hash(hashes.filter("path LIKE '%b'")).first()[0]


def test_line_digest_is_of_content_and_order(spark, tmp_path):
    lines = [f"line {i % 7} of {i}" for i in range(90)]
    variants = {"same": lines, "swapped": [lines[1], lines[0], *lines[2:]], "lost": lines[:-1], "twice": [*lines, lines[0]]}
    for name, own in variants.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.csv").write_text("\n".join(own))
    (tmp_path / "copy").mkdir()
    (tmp_path / "copy" / "other name.csv").write_text("\r\n".join(lines) + "\r\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    found = {}
    for size in (before, "300", "77"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        for name in (*variants, "copy"):
            row = ledger.content_digest(spark, str(tmp_path / name), whole_file=10).first()
            found.setdefault(name, set()).add((row["content_hash"], row["files"]))
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert all(len(seen) == 1 for seen in found.values())
    assert found["same"] == found["copy"] and len({next(iter(v)) for v in found.values()}) == 4
    numbered = ledger.numbered_lines(spark, str(tmp_path / "same")).orderBy("number").collect()
    assert [r["line"] for r in numbered] == lines


def test_small_files_are_identified_by_their_bytes(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a\nb\n")
    whole = ledger.content_digest(spark, str(tmp_path)).first()["content_hash"]
    assert whole == hashlib.sha256(b"a\nb\n").hexdigest()
    assert whole != ledger.content_digest(spark, str(tmp_path), whole_file=1).first()["content_hash"]


def test_pack_catalogue(spark):
    rows = {r["key"]: r for r in pack_catalogue(spark).collect()}
    assert rows["inventory"]["risk_rule_count"] == 10 and rows["inventory"]["metric_count"] == 14
    assert rows["campaigns"]["risk_rule_count"] == 7 and rows["campaigns"]["metric_count"] == 12
    assert len(rows["campaigns"]["required_columns"]) == 11
