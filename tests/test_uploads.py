from pyspark.sql import functions as F, types as T

from panelloom.packs.inventory import PACK
from panelloom.plans import uploads

NAMES = PACK.schema.names


def typed(spark, *rows):
    full = [(e, "ad", "k", "d", p, 1.0, 1.0, stock, 1.0, 2.0, seq) for e, p, stock, seq in rows]
    return spark.createDataFrame(full, T.StructType([*PACK.schema.fields, T.StructField("seq", T.LongType())]))


def shown(series):
    return sorted((r["stok_kodu"] or "", r["donem"], r["donem_sonu_stok"], r["onceki_stok"]) for r in series.collect())


def test_later_upload_wins_whatever_is_repeated(spark):
    first = typed(spark, ("A", "2026-01", 1.0, 5), ("A", "2026-02", 2.0, 6), ("B", "2026-01", 7.0, 7), (None, "2026-01", 3.0, 8))
    second = typed(spark, ("A", "2026-01", 9.0, 0), ("A", "2026-02", 2.0, 1), ("A", "2026-03", 4.0, 2), ("C", "2026-01", 5.0, 3))
    held = uploads.first_upload(uploads.upload_rows(first, "seq", 0), PACK)
    after = uploads.add_upload(held, uploads.upload_rows(second, "seq", 1), PACK)
    assert shown(after.series) == [
        ("A", "2026-01", 9.0, None), ("A", "2026-02", 2.0, 9.0), ("A", "2026-03", 4.0, 2.0), ("B", "2026-01", 7.0, None), ("C", "2026-01", 5.0, None),
    ]
    # a record sent again keeps the place of its first copy: the correction in between stays
    third = typed(spark, ("A", "2026-01", 1.0, 0), ("B", "2026-01", 7.0, 1))
    again = uploads.add_upload(after, uploads.upload_rows(third, "seq", 2), PACK)
    assert shown(again.series) == shown(after.series)
    copies = again.rows.where("stok_kodu = 'A' AND donem = '2026-01'").orderBy("donem_sonu_stok").collect()
    assert [(r["donem_sonu_stok"], r["__copies"]) for r in copies] == [(1.0, 2), (9.0, 1)]
    one = typed(spark, *[(r["stok_kodu"], r["donem"], r["donem_sonu_stok"], i * 100 + r["seq"])
                         for i, part in enumerate((first, second, third)) for r in part.collect()])
    assert shown(uploads.first_upload(uploads.upload_rows(one, "seq", 0), PACK).series) == shown(again.series)


def test_untouched_entities_are_not_analysed_again(spark):
    held = uploads.first_upload(uploads.upload_rows(typed(spark, ("A", "2026-01", 1.0, 0), ("B", "2026-01", 2.0, 1)), "seq", 0), PACK)
    marked = uploads.Holdings(held.rows, held.series.withColumn("marj_yuzde", F.lit(-1.0)))
    after = uploads.add_upload(marked, uploads.upload_rows(typed(spark, ("B", "2026-02", 3.0, 0)), "seq", 1), PACK)
    assert {(r["stok_kodu"], r["marj_yuzde"] == -1) for r in after.series.collect()} == {("A", True), ("B", False)}
