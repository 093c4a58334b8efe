"""Registered queries of the analysis stage, each with its oracle SQL."""

from __future__ import annotations

from collections.abc import Callable
from string import Formatter

from pyspark.sql import DataFrame, SparkSession, functions as F

from checks import oracle_panels as sql
from checks.shape import rounded, split_infinite, split_infinite_sql, tidy, whole
from checks.star_panels import campaign_panel, inventory_panel, table
from panelloom.functions.panel import ROW
from panelloom.operators import deltas, risks, summaries
from panelloom.operators.series import build_series, public_columns
from panelloom.pack import ReportPack, Stage
from panelloom.packs import campaigns, campaigns_texts, inventory, inventory_texts

INV, CMP = inventory.PACK, campaigns.PACK
PANELS = {INV.key: inventory_panel, CMP.key: campaign_panel}
Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def keep(query: Query) -> Query:
        QUERIES[name] = query
        if oracle:
            ORACLES[name] = oracle
        return query

    return keep


def series_of(pack: ReportPack, spark, sf_dir) -> DataFrame:
    return build_series(PANELS[pack.key](spark, sf_dir), pack)


def entities_of(pack: ReportPack, spark, sf_dir) -> DataFrame:
    return summaries.entity_summary(series_of(pack, spark, sf_dir), pack)


def risks_of(pack: ReportPack, spark, sf_dir) -> DataFrame:
    return risks.risk_table(entities_of(pack, spark, sf_dir), pack)


INV_CHAIN = sql.chain(sql.INVENTORY_PANEL, sql.INVENTORY_SERIES)
CMP_CHAIN = sql.chain(sql.CAMPAIGN_PANEL, sql.CAMPAIGN_SERIES)
INV_ENT = sql.chain(*sql.INVENTORY)
CMP_ENT = sql.chain(*sql.CAMPAIGNS)
INV_RSK = sql.chain(*sql.INVENTORY, sql.INVENTORY_RISKS)
CMP_RSK = sql.chain(*sql.CAMPAIGNS, sql.CAMPAIGN_RISKS)

# -- series ---------------------------------------------------------------------
INV_ROW = "ciro_tl satis_maliyeti_tl brut_kar_tl marj_yuzde stok_degeri_tl net_akis"
CMP_ROW = "roas net_kar_tl ctr cpc cpm cpa cvr"
INV_WIN = "onceki_stok cikis_ort3 marj_delta_puan kapama_ay mutabakat_farki"
INV_PCT = "cikis_mom_yuzde maliyet_mom_yuzde"
CMP_WIN = "frekans_delta roas_ort3"
CMP_PCT = "roas_mom_yuzde harcama_mom_yuzde tiklama_mom_yuzde"


@register(
    "row01_07_inventory_row_metrics",
    f"{INV_CHAIN} SELECT stok_kodu, donem, {rounded(INV_ROW)}, {whole('arz_kisitli')} FROM series",
)
def inventory_row_metrics(spark, sf_dir):
    series = series_of(INV, spark, sf_dir)
    return tidy(series.select("stok_kodu", "donem", *INV_ROW.split(), "arz_kisitli"))


@register(
    "row08_14_campaign_row_metrics",
    f"{CMP_CHAIN} SELECT kampanya_id, donem, {rounded(CMP_ROW)} FROM series",
)
def campaign_row_metrics(spark, sf_dir):
    return tidy(series_of(CMP, spark, sf_dir).select("kampanya_id", "donem", *CMP_ROW.split()))


@register(
    "win01_07_inventory_window_metrics",
    f"{INV_CHAIN} SELECT stok_kodu, donem, {rounded(INV_WIN)}, {split_infinite_sql(INV_PCT)} "
    "FROM series",
)
def inventory_window_metrics(spark, sf_dir):
    pct = INV_PCT.split()
    series = series_of(INV, spark, sf_dir).select("stok_kodu", "donem", *INV_WIN.split(), *pct)
    return tidy(split_infinite(pct, series))


@register(
    "win08_12_campaign_window_metrics",
    f"{CMP_CHAIN} SELECT kampanya_id, donem, {rounded(CMP_WIN)}, {split_infinite_sql(CMP_PCT)} "
    "FROM series",
)
def campaign_window_metrics(spark, sf_dir):
    pct = CMP_PCT.split()
    series = series_of(CMP, spark, sf_dir).select("kampanya_id", "donem", *CMP_WIN.split(), *pct)
    return tidy(split_infinite(pct, series))


@register(
    "wix01_row_index",
    f"{INV_CHAIN} SELECT stok_kodu, donem, {whole('rn')} FROM series",
)
def row_index(spark, sf_dir):
    series = series_of(INV, spark, sf_dir)
    return tidy(series.select("stok_kodu", "donem", F.col(ROW).alias("rn")))


@register(
    "src14_series_result_table",
    f"{CMP_CHAIN} SELECT kampanya_id, kampanya_adi, platform, urun_kategorisi, donem, "
    f"{rounded('harcama_tl gosterim tiklama frekans donusum gelir_tl')}, {rounded(CMP_ROW)}, "
    f"{rounded(CMP_WIN)}, {split_infinite_sql(CMP_PCT)} FROM series",
)
def series_result(spark, sf_dir):
    shown = public_columns(series_of(CMP, spark, sf_dir))
    return tidy(split_infinite(CMP_PCT.split(), shown))


# -- period summaries -----------------------------------------------------------
def with_deltas(names: str) -> str:
    """DuckDB select list: the aggregates, their deltas and delta percents."""
    over = "OVER (ORDER BY donem)"
    parts = []
    for n in names.split():
        x, prev = f"CAST({n} AS DOUBLE)", f"CAST(lag({n}) {over} AS DOUBLE)"
        parts.append(f"round({x} - {prev} + 1.2345678e-6, 4) + 0.0 AS {n}_delta")
        parts.append(
            f"round(CASE WHEN {prev} <> 0 THEN ({x} - {prev}) / abs({prev}) * 100 END + 1.2345678e-6, 4) + 0.0 "
            f"AS {n}_delta_pct"
        )
    return ", ".join(parts)


INV_PER = "toplam_ciro_tl toplam_brut_kar_tl ortalama_marj_yuzde toplam_stok_degeri_tl"
INV_PER += " toplam_cikis toplam_giris toplam_stok_adet"
INV_TOTALS = """, totals AS (
  SELECT donem, sum(ciro_tl) AS toplam_ciro_tl, sum(brut_kar_tl) AS toplam_brut_kar_tl,
    CASE WHEN sum(ciro_tl) > 0 THEN sum(brut_kar_tl) / sum(ciro_tl) * 100 END
      AS ortalama_marj_yuzde,
    sum(stok_degeri_tl) AS toplam_stok_degeri_tl,
    count(*) FILTER (donem_sonu_stok <= 0) AS tukenen_urun_sayisi,
    sum(cikis_miktar) AS toplam_cikis, sum(giris_miktar) AS toplam_giris,
    sum(donem_sonu_stok) AS toplam_stok_adet
  FROM series GROUP BY donem)
"""
CMP_PER = "toplam_harcama_tl toplam_gelir_tl portfoy_roas net_katki_tl"
CMP_PER += " toplam_donusum toplam_tiklama toplam_gosterim ortalama_frekans"
CMP_TOTALS = """, totals AS (
  SELECT donem, sum(harcama_tl) AS toplam_harcama_tl, sum(gelir_tl) AS toplam_gelir_tl,
    CASE WHEN sum(harcama_tl) > 0 THEN sum(gelir_tl) / sum(harcama_tl) END AS portfoy_roas,
    sum(gelir_tl) - sum(harcama_tl) AS net_katki_tl,
    count(*) FILTER (roas < 1) AS zarardaki_kampanya,
    sum(donusum) AS toplam_donusum, sum(tiklama) AS toplam_tiklama,
    sum(gosterim) AS toplam_gosterim, avg(frekans) AS ortalama_frekans
  FROM series GROUP BY donem)
"""


def count_deltas(name: str) -> str:
    over = "OVER (ORDER BY donem)"
    return (
        f"{whole(name)}, CAST({name} - lag({name}) {over} AS BIGINT) AS {name}_delta, "
        f"round(CASE WHEN lag({name}) {over} <> 0 THEN ({name} - lag({name}) {over}) / "
        f"CAST(abs(lag({name}) {over}) AS DOUBLE) * 100 END + 1.2345678e-6, 4) + 0.0 AS {name}_delta_pct"
    )


@register(
    "agg01_per01_08_wix02_inventory_period_summary",
    f"{INV_CHAIN}{INV_TOTALS} SELECT donem, {rounded(INV_PER)}, {with_deltas(INV_PER)}, "
    f"{count_deltas('tukenen_urun_sayisi')} FROM totals",
)
def inventory_periods(spark, sf_dir):
    return tidy(summaries.period_summary(series_of(INV, spark, sf_dir), INV))


@register(
    "agg01_per09_17_wix02_campaign_period_summary",
    f"{CMP_CHAIN}{CMP_TOTALS} SELECT donem, {rounded(CMP_PER)}, {with_deltas(CMP_PER)}, "
    f"{count_deltas('zarardaki_kampanya')} FROM totals",
)
def campaign_periods(spark, sf_dir):
    return tidy(summaries.period_summary(series_of(CMP, spark, sf_dir), CMP))


# -- entity summaries -----------------------------------------------------------
TREND = "trend_first trend_last trend_mean trend_last3 trend_step trend_delta_pct"
INV_ENT_D = (
    "toplam_ciro_tl toplam_brut_kar_tl son_stok ilk_stok son_kapama_ay son_marj_yuzde "
    "ilk_marj_yuzde marj_degisim_puan son_birim_maliyet maliyet_degisim_yuzde son_birim_satis "
    "son_stok_degeri_tl ilk_cikis son_cikis ortalama_cikis ilk3_cikis_ort son3_cikis_ort "
    "zirve_cikis net_akis_toplam stok_trend_step cikis_trend_step"
)
INV_ENT_S = (
    "ilk_sifir_donem, zirve_donem, maliyet_sok_donem, marj_dusus_donem, kritik_kapama_donem, "
    "olu_stok_donem, yavas_donem, talep_patlama_donem"
)
CMP_ENT_D = (
    "toplam_harcama_tl toplam_gelir_tl toplam_donusum toplam_roas son_roas ilk_roas "
    "roas_degisim_yuzde son_harcama_tl ilk_harcama_tl harcama_degisim_yuzde son_frekans "
    "ilk_frekans frekans_degisim son_ctr ilk_ctr ctr_degisim_puan son_cpa ilk_cpa son_cvr "
    "net_katki_tl harcama_trend_step"
)


@register(
    "agg02_08_ent01_31_inventory_entity_summary",
    f"{INV_ENT} SELECT stok_kodu, urun_adi, kategori, depo, first_period, last_period, "
    f"{whole('periods_count sifir_stok_donem arz_kisitli_donem')}, {rounded(TREND)}, "
    f"{rounded(INV_ENT_D)}, {INV_ENT_S} FROM entities",
)
def inventory_entities(spark, sf_dir):
    return tidy(entities_of(INV, spark, sf_dir))


@register(
    "agg02_08_ent32_55_campaign_entity_summary",
    f"{CMP_ENT} SELECT kampanya_id, kampanya_adi, urun_kategorisi, platform, first_period, "
    f"last_period, {whole('periods_count zarardaki_donem')}, {rounded(TREND)}, "
    f"{rounded(CMP_ENT_D)}, doyum_donemi, zarar_donemi FROM entities",
)
def campaign_entities(spark, sf_dir):
    return tidy(entities_of(CMP, spark, sf_dir))


@register(
    "top05_top06_peak_first_and_last_three",
    f"{INV_ENT} SELECT stok_kodu, zirve_donem, {rounded('zirve_cikis ilk3_cikis_ort son3_cikis_ort')} "
    "FROM entities",
)
def peaks(spark, sf_dir):
    names = ("stok_kodu", "zirve_donem", "zirve_cikis", "ilk3_cikis_ort", "son3_cikis_ort")
    return tidy(entities_of(INV, spark, sf_dir).select(*names))


# -- dimension summaries --------------------------------------------------------
INV_DIM = """SELECT '{d}' AS dimension, {d} AS dimension_value, donem,
  sum(ciro_tl) AS toplam_ciro_tl, sum(brut_kar_tl) AS toplam_brut_kar_tl,
  CASE WHEN sum(ciro_tl) > 0 THEN sum(brut_kar_tl) / sum(ciro_tl) * 100 END AS ortalama_marj_yuzde,
  sum(stok_degeri_tl) AS toplam_stok_degeri_tl, sum(cikis_miktar) AS toplam_cikis,
  count(DISTINCT stok_kodu) AS urun_sayisi FROM series GROUP BY {d}, donem"""
CMP_DIM = """SELECT '{d}' AS dimension, {d} AS dimension_value, donem,
  sum(harcama_tl) AS toplam_harcama_tl, sum(gelir_tl) AS toplam_gelir_tl,
  CASE WHEN sum(harcama_tl) > 0 THEN sum(gelir_tl) / sum(harcama_tl) END AS portfoy_roas,
  sum(donusum) AS toplam_donusum, count(DISTINCT kampanya_id) AS kampanya_sayisi
  FROM series GROUP BY {d}, donem"""


def dims(template: str, *names: str) -> str:
    return ", dims AS (" + " UNION ALL ".join(template.format(d=d) for d in names) + ")"


INV_DIMS, CMP_DIMS = dims(INV_DIM, "kategori", "depo"), dims(CMP_DIM, "urun_kategorisi", "platform")
INV_DIM_D = "toplam_ciro_tl toplam_brut_kar_tl ortalama_marj_yuzde toplam_stok_degeri_tl toplam_cikis"
CMP_DIM_D = "toplam_harcama_tl toplam_gelir_tl portfoy_roas toplam_donusum"


@register(
    "agg09_joi06_dim01_06_inventory_dimension_summary",
    f"{INV_CHAIN}{INV_DIMS} SELECT dimension, dimension_value, donem, {rounded(INV_DIM_D)}, "
    f"{whole('urun_sayisi')} FROM dims",
)
def inventory_dimensions(spark, sf_dir):
    return tidy(summaries.dimension_summary(series_of(INV, spark, sf_dir), INV))


@register(
    "agg09_joi06_dim07_11_campaign_dimension_summary",
    f"{CMP_CHAIN}{CMP_DIMS} SELECT dimension, dimension_value, donem, {rounded(CMP_DIM_D)}, "
    f"{whole('kampanya_sayisi')} FROM dims",
)
def campaign_dimensions(spark, sf_dir):
    return tidy(summaries.dimension_summary(series_of(CMP, spark, sf_dir), CMP))


# -- headline, counts, periods --------------------------------------------------
# Headline figure, label, unit.
INVENTORY_HEADLINE = (
    ("toplam_ciro_tl", "Toplam Ciro", "TL"),
    ("toplam_brut_kar_tl", "Brüt Kâr", "TL"),
    ("ortalama_marj_yuzde", "Ağırlıklı Marj", "%"),
    ("toplam_stok_degeri_tl", "Stokta Bağlı Sermaye", "TL"),
    ("tukenen_urun_sayisi", "Stoğu Tükenen Ürün", "sayi"),
)
CAMPAIGN_HEADLINE = (
    ("toplam_harcama_tl", "Toplam Harcama", "TL"),
    ("toplam_gelir_tl", "Toplam Gelir", "TL"),
    ("portfoy_roas", "Portföy ROAS", "oran"),
    ("net_katki_tl", "Net Katkı", "TL"),
    ("zarardaki_kampanya", "Zarardaki Kampanya", "sayi"),
)


def headline_sql(figures: tuple[tuple[str, str, str], ...]) -> str:
    parts = [
        f"SELECT '{name}' AS metric, '{label}' AS label, CAST({name} AS DOUBLE) AS value, "
        f"'{unit}' AS unit, donem AS period FROM last"
        for name, label, unit in figures
    ]
    last = ", last AS (SELECT * FROM totals WHERE donem = (SELECT max(donem) FROM totals))"
    body = " UNION ALL ".join(parts)
    return (
        f"{last} SELECT metric, label, {rounded('value')}, unit, CAST(NULL AS VARCHAR) AS entity, "
        f"period FROM ({body}) WHERE value IS NOT NULL"
    )


@register("agg10_inventory_headline", INV_CHAIN + INV_TOTALS + headline_sql(INVENTORY_HEADLINE))
def inventory_headline(spark, sf_dir):
    return tidy(summaries.headline(series_of(INV, spark, sf_dir), INV))


@register("agg10_campaign_headline", CMP_CHAIN + CMP_TOTALS + headline_sql(CAMPAIGN_HEADLINE))
def campaign_headline(spark, sf_dir):
    return tidy(summaries.headline(series_of(CMP, spark, sf_dir), CMP))


@register(
    "agg11_entity_count",
    f"{INV_CHAIN} SELECT count(DISTINCT stok_kodu) AS entity_count FROM series",
)
def entity_count(spark, sf_dir):
    return summaries.entity_count(series_of(INV, spark, sf_dir), INV)


@register(
    "agg11_wix03_periods",
    f"{INV_CHAIN} SELECT donem AS period, lag(donem) OVER (ORDER BY donem) AS previous_period "
    "FROM (SELECT DISTINCT donem FROM series)",
)
def period_list(spark, sf_dir):
    return summaries.periods(series_of(INV, spark, sf_dir), INV)


# -- risks ----------------------------------------------------------------------
RISK_SELECT = (
    "SELECT code, severity, entity, entity_label, round(impact + 1.2345678e-6, 4) + 0.0 AS financial_impact_tl, "
    "first_seen AS first_seen_period"
)
RISK_COLUMNS = (
    "code", "severity", "entity", "entity_label", "financial_impact_tl", "first_seen_period",
)


@register("rsk01_10_inventory_risks", f"{INV_RSK} {RISK_SELECT} FROM risks")
def inventory_risks(spark, sf_dir):
    return tidy(risks_of(INV, spark, sf_dir).select(*RISK_COLUMNS))


@register("rsk11_17_campaign_risks", f"{CMP_RSK} {RISK_SELECT} FROM risks")
def campaign_risks(spark, sf_dir):
    return tidy(risks_of(CMP, spark, sf_dir).select(*RISK_COLUMNS))


def risk_query(name: str, pack: ReportPack, chain: str, code: str):
    @register(name, f"{chain} {RISK_SELECT} FROM risks WHERE code = '{code}'")
    def one_rule(spark, sf_dir):
        found = risks_of(pack, spark, sf_dir).filter(F.col("code") == code)
        return tidy(found.select(*RISK_COLUMNS))


for _no, _rule in enumerate(INV.found_at(Stage.ENTITY), 1):
    risk_query(f"rsk{_no:02d}_{_rule.code.lower()}", INV, INV_RSK, _rule.code)
for _no, _rule in enumerate(CMP.found_at(Stage.ENTITY), 11):
    risk_query(f"rsk{_no:02d}_{_rule.code.lower()}", CMP, CMP_RSK, _rule.code)


# Real volumes are far above the dying-product limit, so this one looks at a panel
# with a 64th of them (an exact binary scale).
THIN = ("giris_miktar", "cikis_miktar", "donem_sonu_stok")
THIN_SERIES = sql.INVENTORY_SERIES.replace(
    "FROM panel)",
    f"FROM (SELECT * REPLACE ({', '.join(f'{c} / 64 AS {c}' for c in THIN)}) FROM panel))",
)


@register(
    "rsk10_dying_sku",
    f"{sql.chain(sql.INVENTORY_PANEL, THIN_SERIES, sql.INVENTORY_ENTITIES, sql.INVENTORY_RISKS)} "
    f"{RISK_SELECT} FROM risks WHERE code = 'DYING_SKU'",
)
def dying_products(spark, sf_dir):
    thin = inventory_panel(spark, sf_dir).withColumns({c: F.col(c) / 64 for c in THIN})
    entities = summaries.entity_summary(build_series(thin, INV), INV)
    found = risks.risk_table(entities, INV).filter("code = 'DYING_SKU'")
    return tidy(found.select(*RISK_COLUMNS))


def evidence_rows(found: DataFrame) -> DataFrame:
    rows = found.select("code", "entity", F.posexplode("evidence").alias("pos", "item"))
    return tidy(rows.select("code", "entity", "pos", "item.metric", "item.value"))


@register(
    "rsk01_10_inventory_evidence",
    f"{INV_ENT} SELECT code, entity, dense_rank() OVER (PARTITION BY code, entity ORDER BY pos) - 1 "
    f"AS pos, metric, {rounded('value')} FROM "
    f"({sql.evidence(sql.INVENTORY_RULES, 'stok_kodu')})",
)
def inventory_evidence(spark, sf_dir):
    return evidence_rows(risks_of(INV, spark, sf_dir))


@register(
    "rsk11_17_campaign_evidence",
    f"{CMP_ENT} SELECT code, entity, dense_rank() OVER (PARTITION BY code, entity ORDER BY pos) - 1 "
    f"AS pos, metric, {rounded('value')} FROM "
    f"({sql.evidence(sql.CAMPAIGN_RULES, 'kampanya_id')})",
)
def campaign_evidence(spark, sf_dir):
    return evidence_rows(risks_of(CMP, spark, sf_dir))


def narrative_sql(template: str) -> str:
    """DuckDB text of a narrative template."""
    parts = []
    for literal, name, spec, _ in Formatter().parse(template):
        if literal:
            parts.append("'" + literal.replace("'", "''") + "'")
        if name is None:
            continue
        value = f"coalesce(CAST({name} AS DOUBLE), 0.0)" if spec else name
        if spec == "tl":
            parts.append(f"replace(format('{{:,.0f}}', {value}), ',', '.') || ' TL'")
        elif spec == "d":
            parts.append(f"CAST(CAST({value} AS BIGINT) AS VARCHAR)")
        elif spec:
            parts.append(f"format('{{:{spec}}}', {value})")
        else:
            parts.append(f"coalesce({value}, 'None')")
    return " || ".join(parts)


def narratives_sql(rules, texts, entity: str) -> str:
    parts = []
    for code, _, when, *_ in rules:
        title, template, advice = (t.replace("'", "''") for t in texts.RISKS[code])
        story = narrative_sql(texts.RISKS[code][1])
        if code == "STOCKOUT":
            lost = narrative_sql(texts.STOCKOUT_LOST_SALES)
            fell = "ilk_cikis <> 0 AND son_cikis <> 0 AND ilk_cikis > son_cikis"
            story += f" || CASE WHEN {fell} THEN {lost} ELSE '' END"
        parts.append(
            f"SELECT '{code}' AS code, {entity} AS entity, '{title}' AS title, {story} AS narrative, "
            f"'{advice}' AS recommendation FROM entities WHERE {when}"
        )
    return " UNION ALL ".join(parts)


@register(
    "rsk_inventory_narratives",
    f"{INV_ENT} {narratives_sql(sql.INVENTORY_RULES, inventory_texts, 'stok_kodu')}",
)
def inventory_narratives(spark, sf_dir):
    return risks_of(INV, spark, sf_dir).select(
        "code", "entity", "title", "narrative", "recommendation"
    )


@register(
    "rsk_campaign_narratives",
    f"{CMP_ENT} {narratives_sql(sql.CAMPAIGN_RULES, campaigns_texts, 'kampanya_id')}",
)
def campaign_narratives(spark, sf_dir):
    return risks_of(CMP, spark, sf_dir).select(
        "code", "entity", "title", "narrative", "recommendation"
    )


RISK_ORDER = "ORDER BY severity_rank, coalesce(impact, 0) DESC, entity, rule_no"


@register(
    "top01_risk_order",
    f"{INV_RSK} {RISK_SELECT}, row_number() OVER ({RISK_ORDER}) - 1 AS position FROM risks",
)
def risk_order(spark, sf_dir):
    """All findings with their place in the order."""
    placed = risks.placed_risks(risks_of(INV, spark, sf_dir))
    return tidy(placed.select(*RISK_COLUMNS, "position"))


@register("top02_top_risks", f"{INV_RSK} {RISK_SELECT} FROM risks {RISK_ORDER} LIMIT 8")
def top_risks(spark, sf_dir):
    return tidy(risks.top_risks(risks_of(INV, spark, sf_dir)).select(*RISK_COLUMNS))


@register(
    "coe07_filtered_risks",
    f"{INV_RSK} {RISK_SELECT} FROM risks WHERE severity = 'kritik' AND first_seen = '1995-02'",
)
def filtered_risks(spark, sf_dir):
    found = risks.filter_risks(risks_of(INV, spark, sf_dir), "kritik", "1995-02")
    return tidy(found.select(*RISK_COLUMNS))


@register(
    "joi04_risks_of_period", f"{CMP_RSK} {RISK_SELECT} FROM risks WHERE first_seen = '1995-01'"
)
def risks_of_period(spark, sf_dir):
    found = risks.risks_of_period(risks_of(CMP, spark, sf_dir), "1995-01")
    return tidy(found.select(*RISK_COLUMNS))


@register(
    "agg12_severity_counts",
    f"{INV_RSK} SELECT severity, count(*) AS count FROM risks GROUP BY severity",
)
def severity_counts(spark, sf_dir):
    return risks.severity_counts(risks_of(INV, spark, sf_dir))


@register(
    "agg12_code_counts",
    f"{CMP_RSK} SELECT code, count(*) AS count FROM risks GROUP BY code",
)
def code_counts(spark, sf_dir):
    return risks.code_counts(risks_of(CMP, spark, sf_dir))


@register(
    "agg13_qry04_risk_totals",
    f"{INV_RSK} SELECT count(*) AS total, round(sum(coalesce(impact, 0)), 2) "
    "AS total_financial_impact_tl FROM risks",
)
def risk_totals(spark, sf_dir):
    return tidy(risks.risk_totals(risks_of(INV, spark, sf_dir)), 2)


@register(
    "top04_prioritised_entities",
    f"{INV_RSK} SELECT stok_kodu, stok_kodu IN (SELECT entity FROM risks) AS risky FROM entities "
    "ORDER BY risky DESC, stok_kodu LIMIT 40",
)
def prioritised(spark, sf_dir):
    found = risks.prioritised_entities(entities_of(INV, spark, sf_dir), INV)
    return found.select("stok_kodu", "risky")


# -- deltas ---------------------------------------------------------------------
def changes_sql(entity: str, label: str, x: str) -> str:
    """Two-period self join: what a pivot on the two periods gives."""
    return f""", cal AS (
  SELECT donem AS period, lag(donem) OVER (ORDER BY donem) AS previous_period
  FROM (SELECT DISTINCT donem FROM series)),
changes AS (
  SELECT c.{entity} AS entity, c.{label} AS label, period, previous_period, c.{x} - q.{x} AS change
  FROM cal JOIN series c ON c.donem = period
  JOIN series q ON q.donem = previous_period AND q.{entity} = c.{entity} AND q.{label} = c.{label}
  WHERE c.{x} - q.{x} IS NOT NULL),
movers AS (
  SELECT *, row_number() OVER (PARTITION BY period, direction ORDER BY abs(change) DESC, entity)
    AS rank
  FROM (SELECT *, CASE WHEN change > 0 THEN 'up' ELSE 'down' END AS direction
        FROM changes WHERE change <> 0)
  QUALIFY rank <= 3)
"""


INV_MOVE = changes_sql("stok_kodu", "urun_adi", "cikis_miktar")
CMP_MOVE = changes_sql("kampanya_id", "kampanya_adi", "harcama_tl")


@register(
    "joi01_period_changes",
    f"{CMP_CHAIN}{CMP_MOVE} SELECT entity, label, period, previous_period, {rounded('change')} "
    "FROM changes",
)
def period_changes(spark, sf_dir):
    return tidy(deltas.changes(series_of(CMP, spark, sf_dir), CMP))


@register(
    "top03_inventory_movers",
    f"{INV_CHAIN}{INV_MOVE} SELECT entity, label, period, previous_period, {rounded('change')}, "
    "direction, rank FROM movers",
)
def inventory_movers(spark, sf_dir):
    return tidy(deltas.top_movers(series_of(INV, spark, sf_dir), INV))


@register(
    "top03_campaign_movers",
    f"{CMP_CHAIN}{CMP_MOVE} SELECT entity, label, period, previous_period, {rounded('change')}, "
    "direction, rank FROM movers",
)
def campaign_movers(spark, sf_dir):
    return tidy(deltas.top_movers(series_of(CMP, spark, sf_dir), CMP))


@register(
    "joi03_new_risks",
    f"{INV_RSK} SELECT first_seen AS period, string_agg(DISTINCT code, ',' ORDER BY code) "
    "AS new_risks FROM risks WHERE first_seen IS NOT NULL GROUP BY 1",
)
def new_risks(spark, sf_dir):
    onsets = risks.risk_onsets(entities_of(INV, spark, sf_dir), INV)
    found = deltas.new_risks(onsets)
    return found.select("period", F.array_join("new_risks", ",").alias("new_risks"))


@register(
    "joi02_period_deltas",
    f"""{sql.chain(*sql.INVENTORY, sql.INVENTORY_RISKS)}{INV_TOTALS}{INV_MOVE}
SELECT cal.period, cal.previous_period,
  round(toplam_ciro_tl + 1.2345678e-6, 2) + 0.0 AS first_metric, 8 AS metric_count,
  coalesce((SELECT string_agg(entity, ',' ORDER BY rank) FROM movers m
            WHERE m.period = cal.period AND direction = 'up'), '') AS up,
  coalesce((SELECT string_agg(entity, ',' ORDER BY rank) FROM movers m
            WHERE m.period = cal.period AND direction = 'down'), '') AS down,
  coalesce((SELECT string_agg(DISTINCT code, ',' ORDER BY code) FROM risks
            WHERE first_seen = cal.period), '') AS new_risks
FROM cal JOIN totals ON donem = cal.period""",
)
def period_deltas(spark, sf_dir):
    series = series_of(INV, spark, sf_dir)
    onsets = risks.risk_onsets(summaries.entity_summary(series, INV), INV)
    found = deltas.period_deltas(summaries.period_summary(series, INV), series, onsets, INV)
    return tidy(
        found.selectExpr(
            "period",
            "previous_period",
            "metrics[0].value AS first_metric",
            "size(metrics) AS metric_count",
            "array_join(transform(movers_up, x -> x.entity), ',') AS up",
            "array_join(transform(movers_down, x -> x.entity), ',') AS down",
            "array_join(new_risks, ',') AS new_risks",
        ),
        2,
    )


@register(
    "joi05_snapshot_pair",
    f"{INV_CHAIN} SELECT CASE WHEN donem = '1998-03' THEN 'current' ELSE 'previous' END AS scope, "
    "donem AS period, stok_kodu, urun_adi, "
    f"{rounded('donem_sonu_stok giris_miktar cikis_miktar marj_yuzde kapama_ay birim_maliyet_tl')}, "
    f"{whole('arz_kisitli')} FROM series WHERE donem IN ('1998-03', "
    "(SELECT max(donem) FROM series WHERE donem < '1998-03'))",
)
def snapshot_pair(spark, sf_dir):
    return tidy(deltas.snapshot_pair(series_of(INV, spark, sf_dir), INV, "1998-03"))


# -- one single period: the event log as a campaign report ------------------------
def event_panel(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return (
        events.groupBy(F.col("user_id").cast("string").alias("kampanya_id"), F.date_format("ts", "yyyy-MM").alias("donem"))
        .agg(
            F.concat(F.lit("user "), F.first("user_id")).alias("kampanya_adi"),
            F.lit("events").alias("platform"),
            F.max("event_type").alias("urun_kategorisi"),
            F.round(F.sum("value"), 2).alias("harcama_tl"),
            F.count(F.lit(1)).cast("double").alias("gosterim"),
            F.count_if(F.col("event_type") == "click").cast("double").alias("tiklama"),
            F.lit(1.0).alias("frekans"),
            F.count_if(F.col("event_type") == "purchase").cast("double").alias("donusum"),
            F.round(F.sum(F.when(F.col("event_type") == "purchase", F.col("value")).otherwise(0.0)), 2).alias("gelir_tl"),
        )
    )


@register(
    "agg06_single_period_entities",
    """SELECT CAST(user_id AS VARCHAR) AS kampanya_id, count(DISTINCT strftime(ts, '%Y-%m')) AS
  periods_count, 0.0 AS trend_step, round(sum(value), 2) + 0.0 AS trend_first,
  CASE WHEN abs(round(sum(value), 2)) > 1e-9 THEN 0.0 END AS trend_delta_pct
FROM events GROUP BY user_id""",
)
def single_period(spark, sf_dir):
    series = build_series(event_panel(spark, sf_dir), CMP)
    found = summaries.entity_summary(series, CMP)
    return tidy(
        found.select("kampanya_id", "periods_count", "trend_step", "trend_first", "trend_delta_pct"), 2
    )
