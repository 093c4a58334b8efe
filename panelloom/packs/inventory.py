"""Inventory report: monthly stock movement and sales by product."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T
from pyspark.sql.functions import col

from panelloom.functions.panel import ROW, Panel, c, safe_ratio, total
from panelloom.functions.text import number, render
from panelloom.pack import Condition, Fill, ReportPack, Stage, Wording, named_at, source_column
from panelloom.packs import inventory_texts as texts

# Thresholds.
COVER_CRITICAL_MONTHS = 1.5
COVER_SLOW_MONTHS = 6.0
COVER_DEAD_MONTHS = 12.0
MARGIN_EROSION_POINTS = 5.0
MARGIN_DROP_POINTS = 3.0
COST_SHOCK_PERCENT = 10.0
SURGE_FACTOR = 1.5
PEAK_FACTOR = 1.2
DYING_VOLUME = 20
BALANCE_TOLERANCE = 0.5


def expected_stock(p):
    """What the previous closing stock and this period's flows add up to."""
    return p.previous(c.donem_sonu_stok) + c.giris_miktar - c.cikis_miktar


ROW_METRICS = {
    "ciro_tl": lambda p: c.cikis_miktar * c.birim_satis_tl,
    "satis_maliyeti_tl": lambda p: c.cikis_miktar * c.birim_maliyet_tl,
    "brut_kar_tl": lambda p: c.cikis_miktar * (c.birim_satis_tl - c.birim_maliyet_tl),
    "marj_yuzde": lambda p: safe_ratio(c.birim_satis_tl - c.birim_maliyet_tl, c.birim_satis_tl, 100),
    "stok_degeri_tl": lambda p: c.donem_sonu_stok * c.birim_maliyet_tl,
    "net_akis": lambda p: c.giris_miktar - c.cikis_miktar,
    "arz_kisitli": lambda p: ((c.donem_sonu_stok <= 0) & (c.cikis_miktar <= c.giris_miktar)).cast("byte"),
}

WINDOW_METRICS = {
    "onceki_stok": lambda p: p.previous(c.donem_sonu_stok),
    "cikis_ort3": lambda p: p.trailing_mean(c.cikis_miktar, 3),
    "cikis_mom_yuzde": lambda p: p.percent_change(c.cikis_miktar),
    "maliyet_mom_yuzde": lambda p: p.percent_change(c.birim_maliyet_tl),
    "marj_delta_puan": lambda p: c.marj_yuzde - p.previous(c.marj_yuzde),
    "kapama_ay": lambda p: safe_ratio(c.donem_sonu_stok, c.cikis_ort3),
    "mutabakat_farki": lambda p: c.donem_sonu_stok - expected_stock(p),
}

PERIOD_AGGREGATES = {
    "toplam_ciro_tl": lambda p: total(c.ciro_tl),
    "toplam_brut_kar_tl": lambda p: total(c.brut_kar_tl),
    "ortalama_marj_yuzde": lambda p: safe_ratio(total(c.brut_kar_tl), total(c.ciro_tl), 100),
    "toplam_stok_degeri_tl": lambda p: total(c.stok_degeri_tl),
    "tukenen_urun_sayisi": lambda p: F.count_if(c.donem_sonu_stok <= 0),
    "toplam_cikis": lambda p: total(c.cikis_miktar),
    "toplam_giris": lambda p: total(c.giris_miktar),
    "toplam_stok_adet": lambda p: total(c.donem_sonu_stok),
}
HEADLINE = (
    "toplam_ciro_tl",
    "toplam_brut_kar_tl",
    "ortalama_marj_yuzde",
    "toplam_stok_degeri_tl",
    "tukenen_urun_sayisi",
)

ENTITY_AGGREGATES = {
    "toplam_ciro_tl": lambda p: total(c.ciro_tl),
    "toplam_brut_kar_tl": lambda p: total(c.brut_kar_tl),
    "son_stok": lambda p: p.last(c.donem_sonu_stok),
    "ilk_stok": lambda p: p.first(c.donem_sonu_stok),
    "son_kapama_ay": lambda p: p.last(c.kapama_ay),
    "son_marj_yuzde": lambda p: p.last(c.marj_yuzde),
    "ilk_marj_yuzde": lambda p: p.first(c.marj_yuzde),
    "marj_degisim_puan": lambda p: p.last(c.marj_yuzde) - p.first(c.marj_yuzde),
    "son_birim_maliyet": lambda p: p.last(c.birim_maliyet_tl),
    "maliyet_degisim_yuzde": lambda p: p.growth_percent(c.birim_maliyet_tl),
    "son_birim_satis": lambda p: p.last(c.birim_satis_tl),
    "son_stok_degeri_tl": lambda p: p.last(c.stok_degeri_tl),
    "sifir_stok_donem": lambda p: F.count_if(c.donem_sonu_stok <= 0),
    "ilk_sifir_donem": lambda p: p.onset(c.donem_sonu_stok <= 0),
    "arz_kisitli_donem": lambda p: F.coalesce(F.sum("arz_kisitli"), F.lit(0)),
    "ilk_cikis": lambda p: p.first(c.cikis_miktar),
    "son_cikis": lambda p: p.last(c.cikis_miktar),
    "ortalama_cikis": lambda p: F.avg(c.cikis_miktar),
    "ilk3_cikis_ort": lambda p: p.head_mean(c.cikis_miktar, 3),
    "son3_cikis_ort": lambda p: p.tail_mean(c.cikis_miktar, 3),
    "zirve_cikis": lambda p: F.max(c.cikis_miktar),
    "zirve_donem": lambda p: p.peak_period(c.cikis_miktar),
    "net_akis_toplam": lambda p: total(c.net_akis),
    "stok_trend_step": lambda p: p.step(c.donem_sonu_stok),
    "cikis_trend_step": lambda p: p.step(c.cikis_miktar),
    "maliyet_sok_donem": lambda p: p.onset(c.maliyet_mom_yuzde > COST_SHOCK_PERCENT),
    "marj_dusus_donem": lambda p: p.onset(c.marj_delta_puan < -MARGIN_DROP_POINTS),
    "kritik_kapama_donem": lambda p: p.onset((c.kapama_ay < COVER_CRITICAL_MONTHS) & (c.donem_sonu_stok > 0)),
    "olu_stok_donem": lambda p: p.onset(c.kapama_ay > COVER_DEAD_MONTHS),
    "yavas_donem": lambda p: p.onset(c.kapama_ay >= COVER_SLOW_MONTHS),
    "talep_patlama_donem": lambda p: p.onset(c.cikis_miktar > col("__ilk3") * SURGE_FACTOR),
}
INTERNAL = {
    "ilk_sifir_donem",
    "zirve_donem",
    "maliyet_sok_donem",
    "marj_dusus_donem",
    "kritik_kapama_donem",
    "olu_stok_donem",
    "yavas_donem",
    "talep_patlama_donem",
}

DIMENSION_AGGREGATES = {
    "toplam_ciro_tl": lambda p: total(c.ciro_tl),
    "toplam_brut_kar_tl": lambda p: total(c.brut_kar_tl),
    "ortalama_marj_yuzde": lambda p: safe_ratio(total(c.brut_kar_tl), total(c.ciro_tl), 100),
    "toplam_stok_degeri_tl": lambda p: total(c.stok_degeri_tl),
    "toplam_cikis": lambda p: total(c.cikis_miktar),
    "urun_sayisi": lambda p: p.entity_count(),
}


FILLS = (
    Fill("giris_miktar", "IMPUTED_FLOW", lambda p: p.own_median(c.giris_miktar)),
    Fill("cikis_miktar", "IMPUTED_FLOW", lambda p: p.own_median(c.cikis_miktar)),
    Fill(
        "donem_sonu_stok",
        "IMPUTED_STOCK",
        expected_stock,
        lambda p: p.following(c.donem_sonu_stok) - p.following(c.giris_miktar) + p.following(c.cikis_miktar),
    ),
)


def check(code, severity, violated, *sample):
    return Condition(Stage.WINDOW, code, severity, violated, ("stok_kodu", "donem", *sample))


CHECKS = (
    check(
        "RECONCILIATION_BREAK",
        "yuksek",
        lambda p: c.onceki_stok.isNotNull()
        & (F.abs("mutabakat_farki") > BALANCE_TOLERANCE),
        "mutabakat_farki",
    ),
    check(
        "NEGATIVE_VALUE",
        "kritik",
        lambda p: (c.giris_miktar < 0) | (c.cikis_miktar < 0) | (c.donem_sonu_stok < 0),
        "donem_sonu_stok",
    ),
    check(
        "MARGIN_INVERSION",
        "kritik",
        lambda p: c.birim_maliyet_tl >= c.birim_satis_tl,
        "birim_maliyet_tl",
        "birim_satis_tl",
    ),
    check(
        "COST_SPIKE",
        "orta",
        lambda p: c.maliyet_mom_yuzde > COST_SHOCK_PERCENT,
        "maliyet_mom_yuzde",
    ),
)


def lost_sales_impact(p):
    lost, periods = number("ilk_cikis") - number("son_cikis"), number("sifir_stok_donem")
    return F.when((lost > 0) & (periods > 0), lost * periods * number("son_birim_satis"))


def stockout_narrative(p):
    first, last = c.ilk_cikis, c.son_cikis
    fell = (first != 0) & (last != 0) & (first > last)
    extra = F.when(fell, render(texts.STOCKOUT_LOST_SALES)).otherwise("")
    return F.concat(render(texts.RISKS["STOCKOUT"][1]), extra)


def finding(code, severity, holds, evidence, impact=None, first_seen=None, narrative=None):
    return Condition(Stage.ENTITY, code, severity, holds, tuple(evidence.split()), impact, first_seen, narrative)


FINDINGS = (
    finding(
        "STOCKOUT",
        "kritik",
        lambda p: (c.son_stok <= 0) & (c.sifir_stok_donem >= 2),
        "son_stok sifir_stok_donem arz_kisitli_donem son_marj_yuzde ilk_cikis son_cikis",
        impact=lost_sales_impact,
        first_seen="ilk_sifir_donem",
        narrative=stockout_narrative,
    ),
    finding(
        "STOCKOUT_IMMINENT",
        "yuksek",
        lambda p: (c.son_stok > 0) & (c.son_kapama_ay < COVER_CRITICAL_MONTHS),
        "son_stok son_kapama_ay son3_cikis_ort son_marj_yuzde",
        impact=lambda p: number("son3_cikis_ort") * number("son_birim_satis"),
        first_seen="kritik_kapama_donem",
    ),
    finding(
        "DEAD_STOCK",
        "yuksek",
        lambda p: c.son_kapama_ay > COVER_DEAD_MONTHS,
        "son_stok son_kapama_ay son_stok_degeri_tl ortalama_cikis",
        impact=lambda p: number("son_stok_degeri_tl"),
        first_seen="olu_stok_donem",
    ),
    finding(
        "SLOW_MOVER",
        "orta",
        lambda p: c.son_kapama_ay.between(COVER_SLOW_MONTHS, COVER_DEAD_MONTHS),
        "son_kapama_ay son_stok son_stok_degeri_tl",
        impact=lambda p: number("son_stok_degeri_tl") * 0.5,
        first_seen="yavas_donem",
    ),
    finding(
        "MARGIN_EROSION",
        "kritik",
        lambda p: c.marj_degisim_puan < -MARGIN_EROSION_POINTS,
        "ilk_marj_yuzde son_marj_yuzde marj_degisim_puan maliyet_degisim_yuzde son_birim_maliyet",
        impact=lambda p: F.abs(number("marj_degisim_puan"))
        / 100
        * number("son_cikis")
        * number("son_birim_satis"),
        first_seen="marj_dusus_donem",
    ),
    finding(
        "COST_SHOCK",
        "yuksek",
        lambda p: c.maliyet_degisim_yuzde > COST_SHOCK_PERCENT,
        "maliyet_degisim_yuzde son_birim_maliyet son_marj_yuzde",
        first_seen="maliyet_sok_donem",
    ),
    finding(
        "SILENT_ACCUMULATION",
        "orta",
        lambda p: (c.stok_trend_step > 0)
        & (c.net_akis_toplam > 0)
        & (c.cikis_trend_step <= 0),
        "stok_trend_step net_akis_toplam ilk_stok son_stok",
        impact=lambda p: number("stok_trend_step")
        * number("periods_count")
        * number("son_birim_maliyet"),
    ),
    finding(
        "DEMAND_SURGE",
        "orta",
        lambda p: (c.cikis_trend_step > 0)
        & (c.ilk3_cikis_ort > 0)
        & (c.son3_cikis_ort > c.ilk3_cikis_ort * SURGE_FACTOR),
        "ilk3_cikis_ort son3_cikis_ort son_stok son_kapama_ay",
        impact=lambda p: (number("son3_cikis_ort") - number("ilk3_cikis_ort"))
        * number("son_birim_satis"),
        first_seen="talep_patlama_donem",
    ),
    finding(
        "SEASONAL_PEAK",
        "bilgi",
        lambda p: (c.zirve_donem != c.first_period)
        & (c.zirve_donem != c.last_period)
        & (c.ortalama_cikis > 0)
        & (c.zirve_cikis > c.ortalama_cikis * PEAK_FACTOR),
        "zirve_cikis ortalama_cikis son_stok",
        first_seen="zirve_donem",
    ),
    finding(
        "DYING_SKU",
        "dusuk",
        lambda p: (c.cikis_trend_step < 0)
        & (c.ortalama_cikis < DYING_VOLUME)
        & (c.son_stok > 0),
        "ilk_cikis son_cikis ortalama_cikis son_stok",
        impact=lambda p: number("son_stok_degeri_tl"),
    ),
)


PACK = ReportPack(
    key="inventory",
    title="Stok ve Satış Raporu",
    description="Ürün bazında dönemsel giriş, çıkış, dönem sonu stok, birim maliyet ve satış fiyatı.",
    panel=Panel("stok_kodu", "donem", "urun_adi"),
    dimensions=("kategori", "depo"),
    schema=T.StructType([source_column(*row) for row in texts.COLUMNS]),
    named=(
        *named_at(Stage.ROW, ROW_METRICS),
        *named_at(Stage.WINDOW, WINDOW_METRICS),
        *named_at(Stage.HELPER, {"__ilk3": lambda p: F.avg(F.when(col(ROW) < 3, c.cikis_miktar)).over(p.whole)}),
        *named_at(Stage.PERIOD, PERIOD_AGGREGATES),
        *named_at(Stage.ENTITY, ENTITY_AGGREGATES),
        *named_at(Stage.DIMENSION, DIMENSION_AGGREGATES),
    ),
    fills=FILLS,
    conditions=(*CHECKS, *FINDINGS),
    wording=Wording(
        {
            Stage.WINDOW: texts.METRICS,
            Stage.PERIOD: texts.PERIOD_AGGREGATES,
            Stage.ENTITY: texts.ENTITY_AGGREGATES,
            Stage.DIMENSION: texts.DIMENSION_AGGREGATES,
        },
        texts.IMPUTATION,
        texts.INTEGRITY,
        texts.RISKS,
    ),
    headline=HEADLINE,
    hidden=frozenset(INTERNAL),
    trend="cikis_miktar",
    snapshot=(
        "donem_sonu_stok",
        "giris_miktar",
        "cikis_miktar",
        "marj_yuzde",
        "kapama_ay",
        "birim_maliyet_tl",
        "arz_kisitli",
    ),
)
