"""Campaign report: monthly ad delivery, spend and revenue by campaign."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T
from pyspark.sql.functions import col

from panelloom.functions.panel import Panel, c, safe_ratio, total
from panelloom.functions.text import number
from panelloom.pack import Condition, Fill, ReportPack, Stage, Wording, named_at, source_column
from panelloom.packs import campaigns_texts as texts

# Thresholds.
LOSS_ROAS = 1.0
STAR_ROAS = 3.0
SATURATION_FREQUENCY = 2.5
ROAS_DROP_PERCENT = -25.0
SPEND_RISE_PERCENT = 50.0
ROAS_HELD_PERCENT = -10.0
FATIGUE_FREQUENCY_RISE = 0.5
LOW_CVR_PERCENT = 2.0
SCALE_UP_SHARE = 0.3


RATIOS = {
    "roas": ("gelir_tl", "harcama_tl", 1),
    "ctr": ("tiklama", "gosterim", 100),
    "cpc": ("harcama_tl", "tiklama", 1),
    "cpm": ("harcama_tl", "gosterim", 1000),
    "cpa": ("harcama_tl", "donusum", 1),
    "cvr": ("donusum", "tiklama", 100),
}


def ratio_of(numerator, denominator, scale):
    return lambda p: safe_ratio(col(numerator), col(denominator), scale)


ROW_METRICS = {name: ratio_of(*parts) for name, parts in RATIOS.items()} | {
    "net_kar_tl": lambda p: c.gelir_tl - c.harcama_tl
}

WINDOW_METRICS = {
    "roas_mom_yuzde": lambda p: p.percent_change(c.roas),
    "harcama_mom_yuzde": lambda p: p.percent_change(c.harcama_tl),
    "tiklama_mom_yuzde": lambda p: p.percent_change(c.tiklama),
    "frekans_delta": lambda p: c.frekans - p.previous(c.frekans),
    "roas_ort3": lambda p: p.trailing_mean(c.roas, 3),
}

PERIOD_AGGREGATES = {
    "toplam_harcama_tl": lambda p: total(c.harcama_tl),
    "toplam_gelir_tl": lambda p: total(c.gelir_tl),
    "portfoy_roas": lambda p: safe_ratio(total(c.gelir_tl), total(c.harcama_tl)),
    "net_katki_tl": lambda p: total(c.gelir_tl) - total(c.harcama_tl),
    "zarardaki_kampanya": lambda p: F.count_if(c.roas < LOSS_ROAS),
    "toplam_donusum": lambda p: total(c.donusum),
    "toplam_tiklama": lambda p: total(c.tiklama),
    "toplam_gosterim": lambda p: total(c.gosterim),
    "ortalama_frekans": lambda p: F.avg(c.frekans),
}
HEADLINE = (
    "toplam_harcama_tl",
    "toplam_gelir_tl",
    "portfoy_roas",
    "net_katki_tl",
    "zarardaki_kampanya",
)

ENTITY_AGGREGATES = {
    "toplam_harcama_tl": lambda p: total(c.harcama_tl),
    "toplam_gelir_tl": lambda p: total(c.gelir_tl),
    "toplam_donusum": lambda p: total(c.donusum),
    "toplam_roas": lambda p: safe_ratio(total(c.gelir_tl), total(c.harcama_tl)),
    "son_roas": lambda p: p.last(c.roas),
    "ilk_roas": lambda p: p.first(c.roas),
    "roas_degisim_yuzde": lambda p: p.growth_percent(c.roas),
    "son_harcama_tl": lambda p: p.last(c.harcama_tl),
    "ilk_harcama_tl": lambda p: p.first(c.harcama_tl),
    "harcama_degisim_yuzde": lambda p: p.growth_percent(c.harcama_tl),
    "son_frekans": lambda p: p.last(c.frekans),
    "ilk_frekans": lambda p: p.first(c.frekans),
    "frekans_degisim": lambda p: p.last(c.frekans) - p.first(c.frekans),
    "son_ctr": lambda p: p.last(c.ctr),
    "ilk_ctr": lambda p: p.first(c.ctr),
    "ctr_degisim_puan": lambda p: p.last(c.ctr) - p.first(c.ctr),
    "son_cpa": lambda p: p.last(c.cpa),
    "ilk_cpa": lambda p: p.first(c.cpa),
    "son_cvr": lambda p: p.last(c.cvr),
    "net_katki_tl": lambda p: total(c.net_kar_tl),
    "zarardaki_donem": lambda p: F.count_if(c.roas < LOSS_ROAS),
    "doyum_donemi": lambda p: p.onset(c.frekans >= SATURATION_FREQUENCY),
    "zarar_donemi": lambda p: p.onset(c.roas < LOSS_ROAS),
    "harcama_trend_step": lambda p: p.step(c.harcama_tl),
}
INTERNAL = ("doyum_donemi", "zarar_donemi")

DIMENSION_AGGREGATES = {
    "toplam_harcama_tl": lambda p: total(c.harcama_tl),
    "toplam_gelir_tl": lambda p: total(c.gelir_tl),
    "portfoy_roas": lambda p: safe_ratio(total(c.gelir_tl), total(c.harcama_tl)),
    "toplam_donusum": lambda p: total(c.donusum),
    "kampanya_sayisi": lambda p: p.entity_count(),
}


def median_fill(code, target):
    return Fill(target, code, lambda p: p.own_median(col(target)))


FILLS = (
    median_fill("IMPUTED_SPEND", "harcama_tl"),
    *[median_fill("IMPUTED_METRICS", t) for t in ("gosterim", "tiklama", "frekans", "donusum", "gelir_tl")],
)


def check(code, severity, violated, *sample):
    return Condition(Stage.WINDOW, code, severity, violated, ("kampanya_id", "donem", *sample))


CHECKS = (
    check(
        "CLICKS_EXCEED_IMPRESSIONS", "kritik", lambda p: c.tiklama > c.gosterim, "tiklama", "gosterim"
    ),
    check(
        "CONVERSIONS_EXCEED_CLICKS", "yuksek", lambda p: c.donusum > c.tiklama, "donusum", "tiklama"
    ),
    check(
        "NEGATIVE_VALUE", "kritik", lambda p: (c.harcama_tl < 0) | (c.gelir_tl < 0), "harcama_tl", "gelir_tl"
    ),
    check(
        "SPEND_WITHOUT_DELIVERY",
        "yuksek",
        lambda p: (c.harcama_tl > 0) & (c.gosterim <= 0),
        "harcama_tl",
        "gosterim",
    ),
)


def finding(code, severity, holds, evidence, impact=None, first_seen=None, narrative=None):
    return Condition(Stage.ENTITY, code, severity, holds, tuple(evidence.split()), impact, first_seen, narrative)


FINDINGS = (
    finding(
        "AD_FATIGUE",
        "kritik",
        lambda p: (c.frekans_degisim > FATIGUE_FREQUENCY_RISE)
        & (c.ctr_degisim_puan < 0)
        & (c.roas_degisim_yuzde < ROAS_DROP_PERCENT),
        "ilk_frekans son_frekans ilk_ctr son_ctr ilk_roas son_roas son_harcama_tl",
        impact=lambda p: number("son_harcama_tl")
        * F.greatest(F.lit(0.0), 1 - number("son_roas")),
        first_seen="doyum_donemi",
    ),
    finding(
        "SCALING_INEFFICIENCY",
        "kritik",
        lambda p: (c.harcama_degisim_yuzde > SPEND_RISE_PERCENT) & (c.roas_degisim_yuzde < ROAS_DROP_PERCENT),
        "ilk_harcama_tl son_harcama_tl harcama_degisim_yuzde ilk_roas son_roas son_cpa",
        impact=lambda p: F.greatest(
            F.lit(0.0), number("son_harcama_tl") - number("ilk_harcama_tl")
        ),
        first_seen="zarar_donemi",
    ),
    finding(
        "UNPROFITABLE",
        "kritik",
        lambda p: c.son_roas < LOSS_ROAS,
        "son_roas net_katki_tl son_harcama_tl zarardaki_donem",
        impact=lambda p: F.abs(F.least(F.lit(0.0), number("net_katki_tl"))),
        first_seen="zarar_donemi",
    ),
    finding(
        "STAR_SCALE_UP",
        "yuksek",
        lambda p: (c.son_roas > STAR_ROAS) & (c.son_frekans < SATURATION_FREQUENCY),
        "son_roas son_frekans son_harcama_tl son_cvr net_katki_tl",
        impact=lambda p: number("son_harcama_tl") * SCALE_UP_SHARE * (number("son_roas") - 1),
    ),
    finding(
        "FREQUENCY_SATURATION",
        "orta",
        lambda p: (c.son_frekans >= SATURATION_FREQUENCY) & (c.roas_degisim_yuzde >= ROAS_DROP_PERCENT),
        "son_frekans frekans_degisim son_roas son_ctr",
        first_seen="doyum_donemi",
    ),
    finding(
        "EFFICIENT_GROWTH",
        "bilgi",
        lambda p: (c.harcama_degisim_yuzde > SPEND_RISE_PERCENT)
        & (c.roas_degisim_yuzde > ROAS_HELD_PERCENT)
        & (c.son_roas > LOSS_ROAS),
        "harcama_degisim_yuzde ilk_roas son_roas toplam_gelir_tl",
    ),
    finding(
        "LOW_CONVERSION",
        "orta",
        lambda p: (c.son_cvr < LOW_CVR_PERCENT) & (c.son_roas < STAR_ROAS),
        "son_cvr son_cpa son_roas",
    ),
)


PACK = ReportPack(
    key="campaigns",
    title="Reklam Performans Raporu",
    description="Kampanya bazında dönemsel harcama, gösterim, tıklama, frekans, dönüşüm ve gelir.",
    panel=Panel("kampanya_id", "donem", "kampanya_adi"),
    dimensions=("urun_kategorisi", "platform"),
    schema=T.StructType([source_column(*row) for row in texts.COLUMNS]),
    named=(
        *named_at(Stage.ROW, ROW_METRICS),
        *named_at(Stage.WINDOW, WINDOW_METRICS),
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
    trend="harcama_tl",
    snapshot=("harcama_tl", "gelir_tl", "roas", "frekans", "ctr", "cvr", "donusum"),
)
