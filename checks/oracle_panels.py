"""DuckDB SQL of the panels, series and summaries, as chained CTEs."""

INVENTORY_PANEL = """
inv_cells AS (
  SELECT l_suppkey, strftime(l_shipdate, '%Y-%m') AS donem,
    sum(CASE WHEN l_returnflag IN ('A','N') THEN l_quantity ELSE 0 END) AS giris_miktar,
    sum(CASE WHEN l_returnflag IN ('R','N') THEN l_quantity ELSE 0 END) AS cikis_miktar,
    round(avg(l_extendedprice / l_quantity * (0.55 + 4 * l_discount)) + 1.2345678e-6, 4) AS birim_maliyet_tl,
    round(avg(l_extendedprice / l_quantity) + 1.2345678e-6, 4) AS birim_satis_tl
  FROM lineitem GROUP BY 1, 2),
panel AS (
  SELECT CAST(l_suppkey AS VARCHAR) AS stok_kodu, s_name AS urun_adi, n_name AS kategori,
    r_name AS depo, donem, giris_miktar, cikis_miktar, birim_maliyet_tl, birim_satis_tl,
    greatest(0.0, 300 + sum(giris_miktar - cikis_miktar) OVER (
      PARTITION BY l_suppkey ORDER BY donem ROWS UNBOUNDED PRECEDING)) AS donem_sonu_stok
  FROM inv_cells JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
"""

CAMPAIGN_PANEL = """
cmp_cells AS (
  SELECT l_suppkey, strftime(l_shipdate, '%Y-%m') AS donem, month(l_shipdate) AS m,
    round(sum(l_extendedprice * l_discount), 4) AS harcama_tl,
    round(sum(CASE WHEN l_returnflag = 'A' THEN 4 * l_extendedprice * l_tax ELSE 0 END), 4)
      AS gelir_tl,
    sum(l_quantity) AS tiklama,
    CAST(count(*) FILTER (l_linestatus = 'F') AS DOUBLE) AS donusum,
    round(1 + avg(l_quantity) / 20 + 1.2345678e-6, 4) AS frekans
  FROM lineitem GROUP BY 1, 2, 3),
panel AS (
  SELECT CAST(l_suppkey AS VARCHAR) AS kampanya_id, s_name AS kampanya_adi, r_name AS platform,
    n_name AS urun_kategorisi, donem, harcama_tl,
    round(30 * tiklama * (0.5 + ((7 * l_suppkey + m) % 11) / 10.0), 2) AS gosterim,
    tiklama, frekans, donusum, gelir_tl
  FROM cmp_cells JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
"""


def pct(x: str, entity: str) -> str:
    """Percent change against the previous row, nulls carried forward."""
    before = (
        f"last_value({x} IGNORE NULLS) OVER (PARTITION BY {entity} ORDER BY donem "
        "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    )
    now = f"coalesce({x}, {before})"
    return (
        f"100 * CASE WHEN {before} IS NULL THEN NULL WHEN {before} <> 0 "
        f"THEN ({now} - {before}) / {before} WHEN {now} > 0 THEN CAST('inf' AS DOUBLE) "
        f"WHEN {now} < 0 THEN CAST('-inf' AS DOUBLE) ELSE CAST('nan' AS DOUBLE) END"
    )


def lag(x: str, entity: str) -> str:
    return f"lag({x}) OVER (PARTITION BY {entity} ORDER BY donem)"


def mean3(x: str, entity: str) -> str:
    return f"avg({x}) OVER (PARTITION BY {entity} ORDER BY donem ROWS 2 PRECEDING)"


E1, E2 = "stok_kodu", "kampanya_id"

INVENTORY_SERIES = f"""
inv_rows AS (
  SELECT *, cikis_miktar * birim_satis_tl AS ciro_tl,
    cikis_miktar * birim_maliyet_tl AS satis_maliyeti_tl,
    cikis_miktar * (birim_satis_tl - birim_maliyet_tl) AS brut_kar_tl,
    CASE WHEN birim_satis_tl > 0
      THEN (birim_satis_tl - birim_maliyet_tl) / birim_satis_tl * 100 END AS marj_yuzde,
    donem_sonu_stok * birim_maliyet_tl AS stok_degeri_tl,
    giris_miktar - cikis_miktar AS net_akis,
    CASE WHEN donem_sonu_stok <= 0 AND cikis_miktar <= giris_miktar THEN 1 ELSE 0 END
      AS arz_kisitli
  FROM panel),
series AS (
  SELECT *, CASE WHEN cikis_ort3 > 0 THEN donem_sonu_stok / cikis_ort3 END AS kapama_ay
  FROM (SELECT *,
    row_number() OVER (PARTITION BY {E1} ORDER BY donem) - 1 AS rn,
    count(*) OVER (PARTITION BY {E1}) AS n,
    {lag('donem_sonu_stok', E1)} AS onceki_stok,
    {mean3('cikis_miktar', E1)} AS cikis_ort3,
    {pct('cikis_miktar', E1)} AS cikis_mom_yuzde,
    {pct('birim_maliyet_tl', E1)} AS maliyet_mom_yuzde,
    marj_yuzde - {lag('marj_yuzde', E1)} AS marj_delta_puan,
    donem_sonu_stok - ({lag('donem_sonu_stok', E1)} + giris_miktar - cikis_miktar)
      AS mutabakat_farki
  FROM inv_rows))
"""


def ratio(a: str, b: str, scale: str = "1") -> str:
    return f"CASE WHEN {b} > 0 THEN {a} / {b} * {scale} END"


CAMPAIGN_SERIES = f"""
cmp_rows AS (
  SELECT *, {ratio('gelir_tl', 'harcama_tl')} AS roas, gelir_tl - harcama_tl AS net_kar_tl,
    {ratio('tiklama', 'gosterim', '100')} AS ctr, {ratio('harcama_tl', 'tiklama')} AS cpc,
    {ratio('harcama_tl', 'gosterim', '1000')} AS cpm, {ratio('harcama_tl', 'donusum')} AS cpa,
    {ratio('donusum', 'tiklama', '100')} AS cvr
  FROM panel),
series AS (
  SELECT *, row_number() OVER (PARTITION BY {E2} ORDER BY donem) - 1 AS rn,
    count(*) OVER (PARTITION BY {E2}) AS n,
    {pct('roas', E2)} AS roas_mom_yuzde, {pct('harcama_tl', E2)} AS harcama_mom_yuzde,
    {pct('tiklama', E2)} AS tiklama_mom_yuzde, frekans - {lag('frekans', E2)} AS frekans_delta,
    {mean3('roas', E2)} AS roas_ort3
  FROM cmp_rows)
"""


def first(x: str) -> str:
    return f"first({x} ORDER BY donem)"


def last(x: str) -> str:
    return f"last({x} ORDER BY donem)"


def growth(x: str) -> str:
    return f"CASE WHEN {first(x)} > 0 THEN ({last(x)} - {first(x)}) / {first(x)} * 100 END"


def step(x: str) -> str:
    return (
        f"CASE WHEN count(*) > 1 THEN ({last(x)} - {first(x)}) / (count(*) - 1) ELSE 0.0 END"
    )


def onset(condition: str) -> str:
    return f"min(donem) FILTER ({condition})"


def trend(x: str) -> str:
    return f"""{first(x)} AS trend_first, {last(x)} AS trend_last, avg({x}) AS trend_mean,
    avg({x}) FILTER (rn >= n - 3) AS trend_last3, {step(x)} AS trend_step,
    CASE WHEN abs({first(x)}) > 1e-9
      THEN ({last(x)} - {first(x)}) / abs({first(x)}) * 100 END AS trend_delta_pct"""


INVENTORY_ENTITIES = f"""
ilk3 AS (SELECT stok_kodu AS k3, avg(cikis_miktar) AS o3 FROM series WHERE rn < 3 GROUP BY 1),
entities AS (
  SELECT stok_kodu, {last('urun_adi')} AS urun_adi, count(*) AS periods_count,
    {first('donem')} AS first_period, {last('donem')} AS last_period,
    {last('kategori')} AS kategori, {last('depo')} AS depo, {trend('cikis_miktar')},
    sum(ciro_tl) AS toplam_ciro_tl, sum(brut_kar_tl) AS toplam_brut_kar_tl,
    {last('donem_sonu_stok')} AS son_stok, {first('donem_sonu_stok')} AS ilk_stok,
    {last('kapama_ay')} AS son_kapama_ay, {last('marj_yuzde')} AS son_marj_yuzde,
    {first('marj_yuzde')} AS ilk_marj_yuzde,
    {last('marj_yuzde')} - {first('marj_yuzde')} AS marj_degisim_puan,
    {last('birim_maliyet_tl')} AS son_birim_maliyet,
    {growth('birim_maliyet_tl')} AS maliyet_degisim_yuzde,
    {last('birim_satis_tl')} AS son_birim_satis, {last('stok_degeri_tl')} AS son_stok_degeri_tl,
    count(*) FILTER (donem_sonu_stok <= 0) AS sifir_stok_donem,
    {onset('donem_sonu_stok <= 0')} AS ilk_sifir_donem,
    CAST(sum(arz_kisitli) AS BIGINT) AS arz_kisitli_donem,
    {first('cikis_miktar')} AS ilk_cikis, {last('cikis_miktar')} AS son_cikis,
    avg(cikis_miktar) AS ortalama_cikis, avg(cikis_miktar) FILTER (rn < 3) AS ilk3_cikis_ort,
    avg(cikis_miktar) FILTER (rn >= n - 3) AS son3_cikis_ort, max(cikis_miktar) AS zirve_cikis,
    first(donem ORDER BY cikis_miktar DESC, donem) AS zirve_donem,
    sum(net_akis) AS net_akis_toplam, {step('donem_sonu_stok')} AS stok_trend_step,
    {step('cikis_miktar')} AS cikis_trend_step,
    {onset('maliyet_mom_yuzde > 10')} AS maliyet_sok_donem,
    {onset('marj_delta_puan < -3')} AS marj_dusus_donem,
    {onset('kapama_ay < 1.5 AND donem_sonu_stok > 0')} AS kritik_kapama_donem,
    {onset('kapama_ay > 12')} AS olu_stok_donem, {onset('kapama_ay >= 6')} AS yavas_donem,
    {onset('cikis_miktar > o3 * 1.5')} AS talep_patlama_donem
  FROM series JOIN ilk3 ON stok_kodu = k3 GROUP BY stok_kodu)
"""

CAMPAIGN_ENTITIES = f"""
entities AS (
  SELECT kampanya_id, {last('kampanya_adi')} AS kampanya_adi, count(*) AS periods_count,
    {first('donem')} AS first_period, {last('donem')} AS last_period,
    {last('urun_kategorisi')} AS urun_kategorisi, {last('platform')} AS platform,
    {trend('harcama_tl')},
    sum(harcama_tl) AS toplam_harcama_tl, sum(gelir_tl) AS toplam_gelir_tl,
    sum(donusum) AS toplam_donusum,
    CASE WHEN sum(harcama_tl) > 0 THEN sum(gelir_tl) / sum(harcama_tl) END AS toplam_roas,
    {last('roas')} AS son_roas, {first('roas')} AS ilk_roas, {growth('roas')} AS roas_degisim_yuzde,
    {last('harcama_tl')} AS son_harcama_tl, {first('harcama_tl')} AS ilk_harcama_tl,
    {growth('harcama_tl')} AS harcama_degisim_yuzde,
    {last('frekans')} AS son_frekans, {first('frekans')} AS ilk_frekans,
    {last('frekans')} - {first('frekans')} AS frekans_degisim,
    {last('ctr')} AS son_ctr, {first('ctr')} AS ilk_ctr,
    {last('ctr')} - {first('ctr')} AS ctr_degisim_puan,
    {last('cpa')} AS son_cpa, {first('cpa')} AS ilk_cpa, {last('cvr')} AS son_cvr,
    sum(net_kar_tl) AS net_katki_tl, count(*) FILTER (roas < 1) AS zarardaki_donem,
    {onset('frekans >= 2.5')} AS doyum_donemi, {onset('roas < 1')} AS zarar_donemi,
    {step('harcama_tl')} AS harcama_trend_step
  FROM series GROUP BY kampanya_id)
"""


def num(x: str) -> str:
    return f"coalesce({x}, 0.0)"


# code, severity, predicate, impact, first seen, evidence
INVENTORY_RULES = (
    ("STOCKOUT", 0, "son_stok <= 0 AND sifir_stok_donem >= 2",
     "CASE WHEN ilk_cikis - son_cikis > 0 AND sifir_stok_donem > 0 "
     "THEN (ilk_cikis - son_cikis) * sifir_stok_donem * son_birim_satis END", "ilk_sifir_donem",
     "son_stok sifir_stok_donem arz_kisitli_donem son_marj_yuzde ilk_cikis son_cikis"),
    ("STOCKOUT_IMMINENT", 1,
     "son_stok > 0 AND son_kapama_ay IS NOT NULL AND son_kapama_ay < 1.5",
     "son3_cikis_ort * son_birim_satis", "kritik_kapama_donem",
     "son_stok son_kapama_ay son3_cikis_ort son_marj_yuzde"),
    ("DEAD_STOCK", 1, "son_kapama_ay > 12", "son_stok_degeri_tl", "olu_stok_donem",
     "son_stok son_kapama_ay son_stok_degeri_tl ortalama_cikis"),
    ("SLOW_MOVER", 2, "son_kapama_ay >= 6 AND son_kapama_ay <= 12", "son_stok_degeri_tl * 0.5",
     "yavas_donem", "son_kapama_ay son_stok son_stok_degeri_tl"),
    ("MARGIN_EROSION", 0, "marj_degisim_puan < -5",
     "abs(marj_degisim_puan) / 100 * son_cikis * son_birim_satis", "marj_dusus_donem",
     "ilk_marj_yuzde son_marj_yuzde marj_degisim_puan maliyet_degisim_yuzde son_birim_maliyet"),
    ("COST_SHOCK", 1, "maliyet_degisim_yuzde > 10", "NULL", "maliyet_sok_donem",
     "maliyet_degisim_yuzde son_birim_maliyet son_marj_yuzde"),
    ("SILENT_ACCUMULATION", 2,
     "stok_trend_step > 0 AND net_akis_toplam > 0 AND cikis_trend_step <= 0",
     "stok_trend_step * periods_count * son_birim_maliyet", "NULL",
     "stok_trend_step net_akis_toplam ilk_stok son_stok"),
    ("DEMAND_SURGE", 2,
     "cikis_trend_step > 0 AND ilk3_cikis_ort > 0 AND son3_cikis_ort > ilk3_cikis_ort * 1.5",
     "(son3_cikis_ort - ilk3_cikis_ort) * son_birim_satis", "talep_patlama_donem",
     "ilk3_cikis_ort son3_cikis_ort son_stok son_kapama_ay"),
    ("SEASONAL_PEAK", 4,
     "zirve_donem <> first_period AND zirve_donem <> last_period AND ortalama_cikis > 0 "
     "AND zirve_cikis > ortalama_cikis * 1.2", "NULL", "zirve_donem",
     "zirve_cikis ortalama_cikis son_stok"),
    ("DYING_SKU", 3, "cikis_trend_step < 0 AND ortalama_cikis < 20 AND son_stok > 0",
     "son_stok_degeri_tl", "NULL", "ilk_cikis son_cikis ortalama_cikis son_stok"),
)

CAMPAIGN_RULES = (
    ("AD_FATIGUE", 0,
     "frekans_degisim > 0.5 AND ctr_degisim_puan < 0 AND roas_degisim_yuzde < -25",
     f"son_harcama_tl * greatest(0.0, 1 - {num('son_roas')})", "doyum_donemi",
     "ilk_frekans son_frekans ilk_ctr son_ctr ilk_roas son_roas son_harcama_tl"),
    ("SCALING_INEFFICIENCY", 0, "harcama_degisim_yuzde > 50 AND roas_degisim_yuzde < -25",
     "greatest(0.0, son_harcama_tl - ilk_harcama_tl)", "zarar_donemi",
     "ilk_harcama_tl son_harcama_tl harcama_degisim_yuzde ilk_roas son_roas son_cpa"),
    ("UNPROFITABLE", 0, "son_roas < 1", "abs(least(0.0, net_katki_tl))", "zarar_donemi",
     "son_roas net_katki_tl son_harcama_tl zarardaki_donem"),
    ("STAR_SCALE_UP", 1, "son_roas > 3 AND son_frekans < 2.5",
     "son_harcama_tl * 0.3 * (son_roas - 1)", "NULL",
     "son_roas son_frekans son_harcama_tl son_cvr net_katki_tl"),
    ("FREQUENCY_SATURATION", 2, "son_frekans >= 2.5 AND roas_degisim_yuzde >= -25", "NULL",
     "doyum_donemi", "son_frekans frekans_degisim son_roas son_ctr"),
    ("EFFICIENT_GROWTH", 4,
     "harcama_degisim_yuzde > 50 AND roas_degisim_yuzde > -10 AND son_roas > 1", "NULL", "NULL",
     "harcama_degisim_yuzde ilk_roas son_roas toplam_gelir_tl"),
    ("LOW_CONVERSION", 2, "son_cvr < 2 AND son_roas < 3", "NULL", "NULL",
     "son_cvr son_cpa son_roas"),
)
SEVERITY = ("kritik", "yuksek", "orta", "dusuk", "bilgi")


def risks(rules, entity: str, label: str) -> str:
    parts = [
        f"SELECT {no} AS rule_no, '{code}' AS code, '{SEVERITY[rank]}' AS severity, "
        f"{rank} AS severity_rank, {entity} AS entity, {label} AS entity_label, "
        f"CAST({impact} AS DOUBLE) AS impact, CAST({seen} AS VARCHAR) AS first_seen "
        f"FROM entities WHERE {when}"
        for no, (code, rank, when, impact, seen, _) in enumerate(rules)
    ]
    return "risks AS (\n  " + "\n  UNION ALL ".join(parts) + ")\n"


def evidence(rules, entity: str) -> str:
    parts = [
        f"SELECT '{code}' AS code, {entity} AS entity, {pos} AS pos, '{m}' AS metric, "
        f"CAST({m} AS DOUBLE) AS value FROM entities WHERE ({when}) AND {m} IS NOT NULL"
        for code, _, when, _, _, metrics in rules
        for pos, m in enumerate(metrics.split())
    ]
    return "\n UNION ALL ".join(parts)


INVENTORY = [INVENTORY_PANEL, INVENTORY_SERIES, INVENTORY_ENTITIES]
CAMPAIGNS = [CAMPAIGN_PANEL, CAMPAIGN_SERIES, CAMPAIGN_ENTITIES]
INVENTORY_RISKS = risks(INVENTORY_RULES, "stok_kodu", "urun_adi")
CAMPAIGN_RISKS = risks(CAMPAIGN_RULES, "kampanya_id", "kampanya_adi")


def chain(*ctes: str) -> str:
    return "WITH " + ",".join(ctes)
