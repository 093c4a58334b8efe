"""The star-schema panels as messy exports: all text, nulls, copies, conflicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from checks.shape import steady_round
from checks.star_panels import campaign_panel, inventory_panel

TEXTS = ("stok_kodu", "urun_adi", "kategori", "depo", "donem")
QUANTITIES = ("giris_miktar", "cikis_miktar", "donem_sonu_stok")
PRICES = ("birim_maliyet_tl", "birim_satis_tl")
SEQ = "seq"


def spell(x: Column, decimals: int, style: Column) -> Column:
    """Four ways to write a number, by style 0-3."""
    english = F.format_number(x, decimals)
    return (
        F.when(style == 1, F.translate(english, ",.", ".,"))
        .when(style == 2, english)
        .when(style == 3, F.concat(F.lit(" "), F.translate(english, ",", ""), F.lit(" ")))
        .otherwise(F.translate(english, ",", ""))
    )


def month_number(period: str = "donem") -> str:
    return f"(int(substring({period}, 1, 4)) * 12 + int(substring({period}, 6, 2)))"


def dirty_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text rows of the inventory report with planted defects and an explicit order."""
    clean = inventory_panel(spark, sf_dir).selectExpr(
        "*", "bigint(stok_kodu) AS s", f"bigint{month_number()} AS k"
    )
    clean = clean.withColumn("h", F.col("s") + F.col("k"))
    # exact copy, conflicting later record, both, or neither
    copies = F.expr(
        "concat(array(0), IF((s * 7 + k) % 29 = 0, array(1), array()), "
        "IF((s * 5 + k) % 31 = 0, array(2), array()))"
    )
    rows = clean.withColumn("copy", F.explode(copies))
    h, style = F.col("h"), F.col("h") % 4
    stock = F.col("donem_sonu_stok") + F.when(F.col("copy") == 2, 11.0).otherwise(0.0)
    sold = F.when(h % 103 == 0, -F.col("cikis_miktar")).otherwise(F.col("cikis_miktar"))
    price_value = steady_round(F.col("birim_satis_tl"), 2)
    price = spell(price_value, 2, style)
    # every 107th row sells at cost
    cost = F.when(h % 107 == 0, price_value).otherwise(
        steady_round(F.col("birim_maliyet_tl"), 2)
    )
    return rows.select(
        "stok_kodu",
        F.when(h % 211 != 0, F.col("urun_adi")).alias("Urun Adi"),
        "kategori",
        F.concat(F.lit(" "), F.col("depo")).alias("DEPO"),
        F.when((F.col("s") * 3 + F.col("k")) % 97 == 0, "OCAK-26")
        .otherwise(F.col("donem"))
        .alias("Period"),
        F.when(h % 19 != 0, spell(F.col("giris_miktar"), 0, style)).alias("giris"),
        F.when(h % 23 != 0, spell(sold, 0, style)).alias("cikis"),
        F.when(h % 17 != 0, spell(stock, 0, style)).alias("son_stok"),
        spell(cost, 2, style).alias("birim-maliyet"),
        F.when(h % 101 == 0, "abc").otherwise(price).alias("satis_fiyati"),
        F.lit("x").alias("note"),
        (F.col("s") * 1000000 + F.col("k") * 10 + F.col("copy")).alias(SEQ),
    )


DIRTY_SQL = """
clean AS (
  SELECT *, CAST(stok_kodu AS BIGINT) AS s, CAST(substr(donem, 1, 4) AS BIGINT) * 12
    + CAST(substr(donem, 6, 2) AS BIGINT) AS k FROM panel),
copied AS (
  SELECT *, s + k AS h, 0 AS copy FROM clean
  UNION ALL SELECT *, s + k AS h, 1 AS copy FROM clean WHERE (s * 7 + k) % 29 = 0
  UNION ALL SELECT *, s + k AS h, 2 AS copy FROM clean WHERE (s * 5 + k) % 31 = 0),
typed AS (
  SELECT stok_kodu, CASE WHEN h % 211 <> 0 THEN urun_adi END AS urun_adi, kategori, depo,
    CASE WHEN (s * 3 + k) % 97 = 0 THEN 'OCAK-26' ELSE donem END AS donem,
    CASE WHEN h % 19 <> 0 THEN giris_miktar END AS giris_miktar,
    CASE WHEN h % 23 <> 0 THEN CASE WHEN h % 103 = 0 THEN -cikis_miktar ELSE cikis_miktar END END
      AS cikis_miktar,
    CASE WHEN h % 17 <> 0 THEN donem_sonu_stok + CASE WHEN copy = 2 THEN 11 ELSE 0 END END
      AS donem_sonu_stok,
    round(CASE WHEN h % 107 = 0 THEN birim_satis_tl ELSE birim_maliyet_tl END + 1.2345678e-6, 2)
      AS birim_maliyet_tl,
    CASE WHEN h % 101 <> 0 THEN round(birim_satis_tl + 1.2345678e-6, 2) END AS birim_satis_tl,
    s * 1000000 + k * 10 + copy AS seq
  FROM copied),
kept AS (SELECT * FROM typed WHERE regexp_matches(donem, '^[0-9]{4}-[0-9]{2}$')),
distinct_rows AS (
  SELECT stok_kodu, urun_adi, kategori, depo, donem, giris_miktar, cikis_miktar, donem_sonu_stok,
    birim_maliyet_tl, birim_satis_tl, min(seq) AS seq, count(*) AS copies
  FROM kept GROUP BY ALL),
unique_rows AS (
  SELECT * EXCLUDE (seq, copies), sum(copies) OVER w AS copies, count(*) OVER w AS variants
  FROM distinct_rows
  WINDOW w AS (PARTITION BY stok_kodu, donem)
  QUALIFY row_number() OVER (PARTITION BY stok_kodu, donem ORDER BY seq DESC) = 1)
"""

IMPUTED_SQL = """
flows AS (
  SELECT * REPLACE (
      coalesce(giris_miktar, median(giris_miktar) OVER (PARTITION BY stok_kodu)) AS giris_miktar,
      coalesce(cikis_miktar, median(cikis_miktar) OVER (PARTITION BY stok_kodu)) AS cikis_miktar),
    giris_miktar IS NULL AND median(giris_miktar) OVER (PARTITION BY stok_kodu) IS NOT NULL
      AS giris_miktar__imputed,
    cikis_miktar IS NULL AND median(cikis_miktar) OVER (PARTITION BY stok_kodu) IS NOT NULL
      AS cikis_miktar__imputed
  FROM unique_rows),
estimates AS (
  SELECT *, lag(donem_sonu_stok) OVER w + giris_miktar - cikis_miktar AS fwd,
    lead(donem_sonu_stok) OVER w - lead(giris_miktar) OVER w + lead(cikis_miktar) OVER w AS bwd
  FROM flows WINDOW w AS (PARTITION BY stok_kodu ORDER BY donem)),
imputed AS (
  SELECT * REPLACE (coalesce(donem_sonu_stok, fwd) AS donem_sonu_stok),
    donem_sonu_stok IS NULL AND fwd IS NOT NULL AS donem_sonu_stok__imputed,
    coalesce(donem_sonu_stok IS NULL AND abs(fwd - bwd) > 0.5, false) AS conflict
  FROM estimates),
checked AS (
  SELECT *, urun_adi IS NOT NULL AND giris_miktar IS NOT NULL AND cikis_miktar IS NOT NULL
    AND donem_sonu_stok IS NOT NULL AND birim_maliyet_tl IS NOT NULL
    AND birim_satis_tl IS NOT NULL AS complete FROM imputed),
tested AS (
  SELECT *, flagged OR coalesce(lag(flagged) OVER w, false) AS exempt,
    lag(donem_sonu_stok) OVER w AS before,
    donem_sonu_stok - (lag(donem_sonu_stok) OVER w + giris_miktar - cikis_miktar) AS gap,
    (birim_maliyet_tl - lag(birim_maliyet_tl) OVER w) / lag(birim_maliyet_tl) OVER w * 100 AS cost_change
  FROM (SELECT *, giris_miktar__imputed OR cikis_miktar__imputed OR donem_sonu_stok__imputed
          AS flagged FROM checked WHERE complete)
  WINDOW w AS (PARTITION BY stok_kodu ORDER BY donem)),
rules AS (
  SELECT stok_kodu, donem, NOT exempt AND before IS NOT NULL AND abs(gap) > 0.5 AS reconciliation,
    NOT exempt AND (giris_miktar < 0 OR cikis_miktar < 0 OR donem_sonu_stok < 0) AS negative,
    NOT exempt AND birim_maliyet_tl >= birim_satis_tl AS inversion,
    NOT exempt AND coalesce(cost_change > 10, false) AS spike, gap, cost_change, donem_sonu_stok
  FROM tested)
"""


def dirty_campaigns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed campaign panel with nulls and impossible figures planted."""
    panel = campaign_panel(spark, sf_dir).selectExpr(
        "*", f"bigint(kampanya_id) + bigint{month_number()} AS h"
    )
    gaps = {"harcama_tl": 13, "gosterim": 17, "tiklama": 19, "frekans": 23, "donusum": 29, "gelir_tl": 31}
    holes = {c: F.when(F.col("h") % n != 0, F.col(c)) for c, n in gaps.items()}
    return (
        panel.withColumns(holes)
        .withColumn(
            "gosterim",
            F.when(F.col("h") % 37 == 0, F.lit(0.0))
            .when(F.col("h") % 41 == 0, F.col("tiklama") / 2)
            .otherwise(F.col("gosterim")),
        )
        .withColumn(
            "donusum",
            F.when(F.col("h") % 43 == 0, F.col("tiklama") + 1).otherwise(F.col("donusum")),
        )
        .withColumn(
            "gelir_tl", F.when(F.col("h") % 47 == 0, F.lit(-1.0)).otherwise(F.col("gelir_tl"))
        )
        .drop("h")
    )


def _median(x: str) -> str:
    return f"median({x}) OVER (PARTITION BY kampanya_id)"


_M = ("harcama_tl", "gosterim", "tiklama", "frekans", "donusum", "gelir_tl")

DIRTY_CAMPAIGN_SQL = f"""
numbered AS (
  SELECT *, CAST(kampanya_id AS BIGINT) + CAST(substr(donem, 1, 4) AS BIGINT) * 12
    + CAST(substr(donem, 6, 2) AS BIGINT) AS h FROM panel),
holes AS (
  SELECT * REPLACE (CASE WHEN h % 13 <> 0 THEN harcama_tl END AS harcama_tl,
    CASE WHEN h % 17 <> 0 THEN gosterim END AS gosterim,
    CASE WHEN h % 19 <> 0 THEN tiklama END AS tiklama,
    CASE WHEN h % 23 <> 0 THEN frekans END AS frekans,
    CASE WHEN h % 29 <> 0 THEN donusum END AS donusum,
    CASE WHEN h % 31 <> 0 THEN gelir_tl END AS gelir_tl) FROM numbered),
planted AS (
  SELECT * REPLACE (
    CASE WHEN h % 37 = 0 THEN 0.0 WHEN h % 41 = 0 THEN tiklama / 2 ELSE gosterim END AS gosterim,
    CASE WHEN h % 43 = 0 THEN tiklama + 1 ELSE donusum END AS donusum,
    CASE WHEN h % 47 = 0 THEN -1.0 ELSE gelir_tl END AS gelir_tl) FROM holes),
filled AS (
  SELECT * REPLACE ({', '.join(f'coalesce({m}, {_median(m)}) AS {m}' for m in _M)}),
    {', '.join(f'{m} IS NULL AND {_median(m)} IS NOT NULL AS {m}__imputed' for m in _M)}
  FROM planted),
tested AS (
  SELECT *, flagged OR coalesce(lag(flagged) OVER (PARTITION BY kampanya_id ORDER BY donem), false)
    AS exempt
  FROM (SELECT *, {' OR '.join(f'{m}__imputed' for m in _M)} AS flagged FROM filled
        WHERE {' AND '.join(f'{m} IS NOT NULL' for m in _M)}))
"""
