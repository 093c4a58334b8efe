"""Registered queries of the ingest stage: scan, coercion, dedup, imputation, quality."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from checks import oracle_panels as sql
from checks.dirty_rows import (
    DIRTY_CAMPAIGN_SQL,
    DIRTY_SQL,
    IMPUTED_SQL,
    SEQ,
    dirty_campaigns,
    dirty_inventory,
    spell,
)
from checks.shape import rounded, tidy, whole
from checks.star_panels import inventory_panel, table
from panelloom.functions import encoding as enc
from panelloom.functions.numbers import read_numbers
from panelloom.operators import coerce as co, dedup, quality
from panelloom.operators.impute import impute
from panelloom.operators.series import build_series
from panelloom.packs import campaigns, inventory
from panelloom.packs.registry import detect_pack
from panelloom.plans import uploads
from panelloom.plans.ingest import ingest
from panelloom.plans.results import quality_table
from panelloom.sources import csv_scan
from panelloom.sources.storage import new_path, store

INV, CMP = inventory.PACK, campaigns.PACK
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def keep(query):
        QUERIES[name] = query
        if oracle:
            ORACLES[name] = oracle
        return query

    return keep


DIRTY = sql.chain(sql.INVENTORY_PANEL, DIRTY_SQL)
IMPUTED = sql.chain(sql.INVENTORY_PANEL, DIRTY_SQL, IMPUTED_SQL)
CAMPAIGN = sql.chain(sql.CAMPAIGN_PANEL, DIRTY_CAMPAIGN_SQL)
TEXT_COLUMNS = "stok_kodu, urun_adi, kategori, depo, donem"
NUMBERS = "giris_miktar cikis_miktar donem_sonu_stok birim_maliyet_tl birim_satis_tl"
FLAGS = "giris_miktar__imputed, cikis_miktar__imputed, donem_sonu_stok__imputed"


def typed_rows(spark, sf_dir):
    return co.coerce(co.map_columns(dirty_inventory(spark, sf_dir), INV, keep=(SEQ,)), INV)


def kept_rows(spark, sf_dir):
    typed = typed_rows(spark, sf_dir)
    return co.drop_bad_periods(typed, INV, co.has_bad_period(typed, INV))


def unique_rows(spark, sf_dir):
    return dedup.deduplicate(kept_rows(spark, sf_dir), INV, SEQ)


def imputed_rows(spark, sf_dir):
    return impute(unique_rows(spark, sf_dir), INV)


def checked_rows(spark, sf_dir):
    clean, _ = quality.quarantine(imputed_rows(spark, sf_dir), INV)
    return quality.with_violations(build_series(clean, INV), INV)


# -- coercion -------------------------------------------------------------------
@register(
    "coe01_coe03_src03_src04_typed_rows",
    f"{DIRTY} SELECT {TEXT_COLUMNS}, {rounded(NUMBERS)}, CAST(seq AS BIGINT) AS seq FROM typed",
)
def typed(spark, sf_dir):
    return tidy(typed_rows(spark, sf_dir))


@register(
    "coe02_number_spellings",
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate::DATE AS shipped, "
    f"{rounded('value', 2)}, count(*) AS n FROM (SELECT *, l_extendedprice AS value FROM lineitem) "
    "GROUP BY ALL",
)
def number_spellings(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    text = spell(F.col("l_extendedprice"), 2, F.col("l_linenumber") % 4)
    read = lines.select(
        "l_orderkey",
        F.col("l_linenumber").cast("bigint"),
        "l_partkey",
        "l_suppkey",
        F.col("l_shipdate").cast("date").alias("shipped"),
        text.alias("value"),
    )
    shown = tidy(read_numbers(read, {"value": "double"}), 2)
    return shown.groupBy(*shown.columns).agg(F.count(F.lit(1)).alias("n"))


@register(
    "coe04_integer_cast",
    "SELECT l_linenumber::BIGINT AS l_linenumber, sum(CASE WHEN l_linenumber % 5 <> 0 THEN "
    "trunc(l_extendedprice) END)::BIGINT AS total, "
    "count(*) FILTER (l_linenumber % 5 = 0) AS unreadable FROM lineitem GROUP BY 1",
)
def integer_cast(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").withColumn("line", F.col("l_linenumber").cast("bigint"))
    text = F.when(F.col("line") % 5 == 0, F.lit("12.34.56")).otherwise(
        spell(F.col("l_extendedprice"), 2, F.col("line") % 4)
    )
    value = F.col("value")
    lines = read_numbers(lines.withColumn("value", text), {"value": "bigint"})
    return lines.groupBy(F.col("line").alias("l_linenumber")).agg(
        F.sum(value).alias("total"), F.count_if(value.isNull()).alias("unreadable")
    )


@register(
    "coe05_missing_counts",
    f"{DIRTY} SELECT "
    + ", ".join(f"count(*) FILTER ({n} IS NULL) AS missing_{n}" for n in NUMBERS.split())
    + " FROM typed",
)
def missing(spark, sf_dir):
    counts = co.missing_counts(INV, INV.measures)
    return typed_rows(spark, sf_dir).agg(*[c.alias(n) for n, c in counts.items()])


@register(
    "coe06_period_filter",
    f"{DIRTY} SELECT CAST(seq AS BIGINT) AS seq, donem FROM kept",
)
def period_filter(spark, sf_dir):
    return kept_rows(spark, sf_dir).select("seq", "donem")


@register(
    "coe06_bad_period_rows",
    f"{DIRTY} SELECT donem, count(*) AS rows FROM typed "
    "WHERE NOT regexp_matches(donem, '^[0-9]{4}-[0-9]{2}$') GROUP BY 1",
)
def bad_periods(spark, sf_dir):
    bad = typed_rows(spark, sf_dir).filter(co.bad_period(INV))
    return bad.groupBy("donem").agg(F.count(F.lit(1)).alias("rows"))


# -- deduplication --------------------------------------------------------------
@register(
    "ded01_distinct_rows",
    f"{DIRTY} SELECT {TEXT_COLUMNS}, {rounded(NUMBERS)}, {whole('seq copies')} FROM distinct_rows",
)
def distinct_rows(spark, sf_dir):
    found = dedup.drop_exact_copies(kept_rows(spark, sf_dir), SEQ)
    return tidy(found.withColumnRenamed(dedup.COPIES, "copies"))


@register(
    "ded02_ded03_last_record",
    f"{DIRTY} SELECT {TEXT_COLUMNS}, {rounded(NUMBERS)}, {whole('copies variants')} "
    "FROM unique_rows",
)
def last_record(spark, sf_dir):
    found = unique_rows(spark, sf_dir)
    return tidy(
        found.withColumnsRenamed({dedup.COPIES: "copies", dedup.VARIANTS: "variants"})
    )


@register(
    "ded_removed_counts",
    f"{DIRTY} SELECT CAST(sum(copies - variants) AS BIGINT) AS exact_removed, "
    "CAST(sum(variants - 1) AS BIGINT) AS key_removed FROM unique_rows",
)
def removed_counts(spark, sf_dir):
    copies, variants = F.col(dedup.COPIES), F.col(dedup.VARIANTS)
    return unique_rows(spark, sf_dir).agg(
        F.sum(copies - variants).alias("exact_removed"), F.sum(variants - 1).alias("key_removed")
    )


LATE = "(s % 3 = 0 AND (copy = 2 OR donem >= '1999'))"
LATE_TYPED = (
    DIRTY_SQL.replace("s * 1000000 + k * 10 + copy AS seq", f"s * 1000000 + k * 10 + copy + IF({LATE}, 1000000000000, 0) AS seq")
    .replace("FROM copied)", f"FROM copied WHERE {LATE} OR (copy <> 2 AND donem < '2000'))")
)


@register(
    "ded02_late_uploads",
    f"{sql.chain(sql.INVENTORY_PANEL, LATE_TYPED, IMPUTED_SQL)} SELECT stok_kodu, donem, {rounded(NUMBERS)}, {FLAGS} "
    "FROM checked WHERE complete",
)
def late_uploads(spark, sf_dir):
    """Two uploads, the second with corrections and new months of a third of the products."""
    rows = kept_rows(spark, sf_dir)
    s, k, copy = (F.expr(x) for x in (f"{SEQ} div 1000000", f"({SEQ} % 1000000) div 10", f"{SEQ} % 10"))
    month = F.concat_ws("-", F.lpad(((k - 1) / 12).cast("int").cast("string"), 4, "0"), F.lit("01"))
    late = (s % 3 == 0) & ((copy == 2) | (month >= "1999-01"))
    first = rows.where(~late & (copy != 2) & (month < "2000-01"))
    held = uploads.first_upload(uploads.upload_rows(first, SEQ, 0), INV)
    held = uploads.add_upload(held, uploads.upload_rows(rows.where(late), SEQ, 1), INV)
    flags = [c.strip() for c in FLAGS.split(",")]
    return tidy(held.series.select("stok_kodu", "donem", *NUMBERS.split(), *flags))


# -- imputation -----------------------------------------------------------------
@register(
    "im01_03_imx01_imx03_inventory_imputation",
    f"{IMPUTED} SELECT {TEXT_COLUMNS}, {rounded(NUMBERS)}, {FLAGS} FROM imputed",
)
def inventory_imputation(spark, sf_dir):
    found = imputed_rows(spark, sf_dir)
    names = [c.strip() for c in f"{TEXT_COLUMNS}, {FLAGS}".split(",")]
    return tidy(found.select(*names, *NUMBERS.split()))


@register(
    "imx02_conflicting_estimates",
    f"{IMPUTED} SELECT stok_kodu, donem, {rounded('fwd bwd')} FROM imputed WHERE conflict",
)
def conflicts(spark, sf_dir):
    found = imputed_rows(spark, sf_dir).filter("__conflict_donem_sonu_stok")
    return tidy(
        found.selectExpr(
            "stok_kodu", "donem", "__fwd_donem_sonu_stok AS fwd", "__bwd_donem_sonu_stok AS bwd"
        )
    )


CMP_NUMBERS = "harcama_tl gosterim tiklama frekans donusum gelir_tl"
CMP_FLAGS = [f"{m}__imputed" for m in CMP_NUMBERS.split()]


@register(
    "im04_09_campaign_imputation",
    f"{CAMPAIGN} SELECT kampanya_id, donem, {rounded(CMP_NUMBERS)}, {', '.join(CMP_FLAGS)} "
    "FROM filled",
)
def campaign_imputation(spark, sf_dir):
    found = impute(dirty_campaigns(spark, sf_dir), CMP)
    return tidy(found.select("kampanya_id", "donem", *CMP_NUMBERS.split(), *CMP_FLAGS))


# -- quality --------------------------------------------------------------------
@register(
    "qua01_period_gaps",
    f"{IMPUTED} SELECT stok_kodu, count(DISTINCT donem) AS periods, "
    "(SELECT count(DISTINCT donem) FROM imputed) AS all_periods FROM imputed GROUP BY 1 "
    "HAVING count(DISTINCT donem) < (SELECT count(DISTINCT donem) FROM imputed)",
)
def gaps(spark, sf_dir):
    return quality.period_gaps(imputed_rows(spark, sf_dir), INV).drop("missing")


@register(
    "qua01_missing_periods",
    f"{IMPUTED}, every AS (SELECT DISTINCT donem FROM imputed), "
    "named AS (SELECT DISTINCT stok_kodu FROM imputed) "
    "SELECT stok_kodu, donem AS missing FROM named, every WHERE NOT EXISTS "
    "(SELECT 1 FROM imputed i WHERE i.stok_kodu = named.stok_kodu AND i.donem = every.donem)",
)
def missing_periods(spark, sf_dir):
    found = quality.period_gaps(imputed_rows(spark, sf_dir), INV)
    return found.select("stok_kodu", F.explode("missing").alias("missing"))


@register(
    "qua02_quarantined_rows",
    f"{IMPUTED} SELECT stok_kodu, donem FROM checked WHERE NOT complete",
)
def quarantined(spark, sf_dir):
    return quality.quarantine(imputed_rows(spark, sf_dir), INV)[1].select("stok_kodu", "donem")


@register(
    "qua02_clean_rows",
    f"{IMPUTED} SELECT stok_kodu, donem, {rounded(NUMBERS)} FROM checked WHERE complete",
)
def clean_rows(spark, sf_dir):
    clean, _ = quality.quarantine(imputed_rows(spark, sf_dir), INV)
    return tidy(clean.select("stok_kodu", "donem", *NUMBERS.split()))


RULES = {
    "int01_reconciliation_break": ("RECONCILIATION_BREAK", "reconciliation"),
    "int02_negative_value": ("NEGATIVE_VALUE", "negative"),
    "int03_margin_inversion": ("MARGIN_INVERSION", "inversion"),
    "int04_cost_spike": ("COST_SPIKE", "spike"),
}


def integrity_query(name: str, code: str, flag: str) -> None:
    @register(name, f"{IMPUTED} SELECT stok_kodu, donem FROM rules WHERE {flag}")
    def offending(spark, sf_dir):
        return checked_rows(spark, sf_dir).filter(f"__bad_{code}").select("stok_kodu", "donem")


for _name, (_code, _flag) in RULES.items():
    integrity_query(_name, _code, _flag)


@register(
    "qua03_04_inventory_violation_counts",
    f"{IMPUTED} "
    + " UNION ALL ".join(
        f"SELECT '{code}' AS code, count(*) FILTER ({flag}) AS affected_rows FROM rules"
        for code, flag in RULES.values()
    ),
)
def violation_counts(spark, sf_dir):
    return quality.violation_counts(checked_rows(spark, sf_dir))


CMP_RULES = {
    "CLICKS_EXCEED_IMPRESSIONS": "tiklama > gosterim",
    "CONVERSIONS_EXCEED_CLICKS": "donusum > tiklama",
    "NEGATIVE_VALUE": "harcama_tl < 0 OR gelir_tl < 0",
    "SPEND_WITHOUT_DELIVERY": "harcama_tl > 0 AND gosterim <= 0",
}


@register(
    "int05_08_campaign_violations",
    f"{CAMPAIGN} "
    + " UNION ALL ".join(
        f"SELECT '{code}' AS code, kampanya_id, donem FROM tested WHERE NOT exempt AND ({test})"
        for code, test in CMP_RULES.items()
    ),
)
def campaign_violations(spark, sf_dir):
    clean, _ = quality.quarantine(impute(dirty_campaigns(spark, sf_dir), CMP), CMP)
    checked = quality.with_violations(build_series(clean, CMP), CMP)
    named = ", ".join(f"IF(__bad_{c}, '{c}', NULL)" for c in CMP_RULES)
    return checked.selectExpr(
        f"explode(array_compact(array({named}))) AS code", "kampanya_id", "donem"
    )


@register(
    "qua05_cost_spike_samples",
    f"{IMPUTED} SELECT stok_kodu || ' / ' || donem || ' / ' || "
    "replace(format('{:,.2f}', cost_change), ',', ' ') AS sample "
    "FROM rules WHERE spike ORDER BY stok_kodu, donem LIMIT 5",
)
def spike_samples(spark, sf_dir):
    text = quality.sample_text(INV, ("stok_kodu", "donem", "maliyet_mom_yuzde"))
    rules = {"COST_SPIKE": (F.col("__bad_COST_SPIKE"), text)}
    found = quality.sample_lists(checked_rows(spark, sf_dir), rules, INV)
    return found.select(F.explode("samples").alias("sample"))


# -- files ----------------------------------------------------------------------
def write_export(spark, sf_dir) -> str:
    """The messy rows as CSV files in the shared folder, in `seq` order per file."""
    path = new_path(spark, "export")
    rows = dirty_inventory(spark, sf_dir)
    blank = rows.limit(0).drop(SEQ)
    ordered = rows.repartitionByRange(SEQ).sortWithinPartitions(SEQ).drop(SEQ)
    ordered.unionByName(blank).write.option("header", True).option("escape", '"').option(
        "ignoreLeadingWhiteSpace", False
    ).option("ignoreTrailingWhiteSpace", False).csv(path)
    return path


@register(
    "src01_src02_csv_scan",
    f"{DIRTY} SELECT {TEXT_COLUMNS}, {rounded(NUMBERS)}, count(*) AS n FROM typed GROUP BY ALL",
)
def csv_rows(spark, sf_dir):
    scan = csv_scan.scan_csv(spark, write_export(spark, sf_dir))
    read = tidy(co.coerce(co.map_columns(scan.rows, INV), INV))
    return read.groupBy(*read.columns).agg(F.count(F.lit(1)).alias("n"))


@register(
    "src05_detected_pack", f"{DIRTY} SELECT '{INV.key}' AS pack, count(*) AS rows FROM typed"
)
def detected(spark, sf_dir):
    """The report type of an export, from the header of its files, with the rows it applies to."""
    scan = csv_scan.scan_csv(spark, write_export(spark, sf_dir))
    pack = detect_pack(scan.headers)
    return scan.rows.agg(F.lit(pack.key).alias("pack"), F.count(F.lit(1)).alias("rows"))


ISSUE_SQL = f"""{IMPUTED}, issues AS (
  {' UNION ALL '.join(
      f"SELECT 'MISSING_DETECTED' AS code, 'bilgi' AS severity, 'isaretlendi' AS action, count(*) "
      f"FILTER ({n} IS NULL) AS affected_rows, {i} AS step FROM typed" for i, n in enumerate(NUMBERS.split(), 1))}
  UNION ALL SELECT 'UNKNOWN_COLUMNS', 'bilgi', 'isaretlendi', 0, 0 FROM typed
    GROUP BY ALL HAVING count(*) > 0
  UNION ALL SELECT 'INVALID_PERIOD_FORMAT', 'yuksek', 'karantina', count(*), 6 FROM typed
    WHERE donem = 'OCAK-26'
  UNION ALL SELECT 'DUPLICATE_EXACT', 'orta', 'silindi', sum(copies - variants), 7 FROM unique_rows
  UNION ALL SELECT 'DUPLICATE_KEY', 'yuksek', 'silindi', sum(variants - 1), 8 FROM unique_rows
  UNION ALL SELECT 'IMPUTED_FLOW', 'orta', 'turetildi', count(*), 9 FROM imputed
    WHERE giris_miktar__imputed
  UNION ALL SELECT 'IMPUTED_FLOW', 'orta', 'turetildi', count(*), 10 FROM imputed
    WHERE cikis_miktar__imputed
  UNION ALL SELECT 'IMPUTATION_AMBIGUOUS', 'yuksek', 'isaretlendi', count(*), 11 FROM imputed
    WHERE conflict
  UNION ALL SELECT 'IMPUTED_STOCK', 'orta', 'turetildi', count(*), 12 FROM imputed
    WHERE donem_sonu_stok__imputed
  UNION ALL SELECT 'PERIOD_GAP', 'orta', 'isaretlendi', count(*), 13 FROM (
    SELECT stok_kodu FROM imputed GROUP BY 1
    HAVING count(*) < (SELECT count(DISTINCT donem) FROM imputed))
  UNION ALL SELECT 'ROW_QUARANTINED', 'yuksek', 'karantina', count(*), 14 FROM checked WHERE NOT complete
  UNION ALL SELECT 'RECONCILIATION_BREAK', 'yuksek', 'isaretlendi', count(*), 15 FROM rules
    WHERE reconciliation
  UNION ALL SELECT 'NEGATIVE_VALUE', 'kritik', 'isaretlendi', count(*), 16 FROM rules WHERE negative
  UNION ALL SELECT 'MARGIN_INVERSION', 'kritik', 'isaretlendi', count(*), 17 FROM rules WHERE inversion
  UNION ALL SELECT 'COST_SPIKE', 'orta', 'isaretlendi', count(*), 18 FROM rules WHERE spike),
found AS (SELECT * FROM issues WHERE affected_rows > 0 OR code = 'UNKNOWN_COLUMNS')
"""


@register(
    "qua06_qry05_csv_quality_issues",
    f"{ISSUE_SQL} SELECT code, severity, action, CAST(affected_rows AS BIGINT) AS affected_rows, row_number() OVER "
    "(ORDER BY list_position(['kritik', 'yuksek', 'orta', 'dusuk', 'bilgi'], severity), step) - 1 AS position "
    "FROM found",
)
def csv_issues(spark, sf_dir):
    """The issues of an ingest with their place in the report."""
    table = quality_table(ingest(spark, write_export(spark, sf_dir)))
    return table.select("code", "severity", "action", "affected_rows", "position")


PENALTY_SQL = """
  SELECT sum(CASE severity WHEN 'kritik' THEN 25 WHEN 'yuksek' THEN 12 WHEN 'orta' THEN 6
    WHEN 'dusuk' THEN 3 ELSE 1 END
    * CASE WHEN action IN ('onarildi', 'turetildi', 'silindi') THEN 0.4 ELSE 1 END) AS p,
    count(*) AS issue_count FROM found"""


@register(
    "qua07_08_health_report",
    f"""{ISSUE_SQL}, penalty AS ({PENALTY_SQL})
SELECT (SELECT count(*) FROM typed) AS raw_row_count,
  (SELECT count(*) FROM checked WHERE complete) AS clean_row_count,
  (SELECT count(*) FROM checked WHERE NOT complete) AS quarantined_row_count,
  CAST(greatest(0, least(100, round_even(100 - p, 0))) AS BIGINT) AS health_score, issue_count,
  'utf-8-sig' AS encoding_detected, false AS encoding_repaired, false AS has_blocking_issues
FROM penalty""",
)
def health_report(spark, sf_dir):
    return tidy(ingest(spark, write_export(spark, sf_dir)).report.drop("issues"))


KEY_TEXT = "s.stok_kodu || ' / ' || s.donem"
MONEY = "replace(format('{{:,.2f}}', {}), ',', ' ')"


def figures(*names: str) -> str:
    return "".join(f" || ' / ' || {MONEY.format(n)}" for n in names)


@register(
    "qua05_ingest_samples",
    f"""{IMPUTED}, found AS (
  SELECT 'DUPLICATE_KEY' AS code, stok_kodu, donem, {KEY_TEXT} || ' (' || variants::BIGINT || ' kayıt)' AS sample
    FROM unique_rows s WHERE variants > 1
  UNION ALL SELECT 'IMPUTATION_AMBIGUOUS', stok_kodu, donem,
    {KEY_TEXT} || ': ileri=' || format('{{:.0f}}', fwd) || ' geri=' || format('{{:.0f}}', bwd)
    FROM imputed s WHERE conflict
  UNION ALL SELECT 'PERIOD_GAP', stok_kodu, NULL, stok_kodu || ': ' || count(*) || '/'
    || (SELECT count(DISTINCT donem) FROM imputed) || ' dönem' FROM imputed GROUP BY stok_kodu
    HAVING count(*) < (SELECT count(DISTINCT donem) FROM imputed)
  UNION ALL SELECT 'ROW_QUARANTINED', stok_kodu, donem, {KEY_TEXT} FROM checked s WHERE NOT complete
  UNION ALL SELECT 'RECONCILIATION_BREAK', stok_kodu, donem, {KEY_TEXT}{figures("gap")}
    FROM rules s WHERE reconciliation
  UNION ALL SELECT 'NEGATIVE_VALUE', stok_kodu, donem, {KEY_TEXT}{figures("donem_sonu_stok")}
    FROM rules s WHERE negative
  UNION ALL SELECT 'MARGIN_INVERSION', s.stok_kodu, s.donem,
    {KEY_TEXT}{figures("birim_maliyet_tl", "birim_satis_tl")}
    FROM rules s JOIN checked c ON c.stok_kodu = s.stok_kodu AND c.donem = s.donem WHERE inversion
  UNION ALL SELECT 'COST_SPIKE', stok_kodu, donem, {KEY_TEXT}{figures("cost_change")} FROM rules s WHERE spike
  UNION ALL SELECT 'INVALID_PERIOD_FORMAT', NULL, donem, donem FROM typed WHERE donem = 'OCAK-26' GROUP BY donem
  UNION ALL SELECT 'UNKNOWN_COLUMNS', NULL, NULL, 'note' FROM typed GROUP BY ALL HAVING count(*) > 0)
SELECT code, place, sample FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY stok_kodu, donem) - 1
  AS place FROM found) WHERE place < 5""",
)
def ingest_samples(spark, sf_dir):
    """The sample texts of every issue of an ingest, in order."""
    issues = ingest(spark, write_export(spark, sf_dir)).issues
    return issues.select("code", F.posexplode("samples").alias("place", "sample")).withColumn(
        "place", F.col("place").cast("bigint")
    )


# -- files with line breaks in cells ----------------------------------------------
BROKEN_NAME = "2. satır, \"özel\""


def broken_cells(spark, sf_dir):
    """Names that hold line breaks, quotes, inch marks or commas, as cells of a CSV file."""
    panel = inventory_panel(spark, sf_dir)
    kind = F.expr("(bigint(stok_kodu) + bigint(right(donem, 2))) % 4")
    name = F.col("urun_adi")
    cell = (
        F.when(kind == 0, F.concat(F.lit('"'), name, F.lit("\n" + BROKEN_NAME.replace('"', '""') + '"')))
        .when(kind == 1, F.concat(name, F.lit(' 5" boru')))
        .when(kind == 2, F.concat(F.lit('"'), name, F.lit(', A"')))
        .otherwise(name)
    )
    return panel.select("stok_kodu", "donem", "donem_sonu_stok", cell.alias("cell"))


@register(
    "src01_quoted_breaks",
    f"{sql.chain(sql.INVENTORY_PANEL)} SELECT stok_kodu, CASE (stok_kodu::BIGINT + right(donem, 2)::BIGINT) % 4 "
    f"WHEN 0 THEN urun_adi || chr(10) || '{BROKEN_NAME}' WHEN 1 THEN urun_adi || ' 5\" boru' "
    "WHEN 2 THEN urun_adi || ', A' ELSE urun_adi END AS urun_adi, donem FROM panel",
)
def quoted_breaks(spark, sf_dir):
    """Eight files whose cells hold line breaks and stray inch marks, read block by block."""
    cells = broken_cells(spark, sf_dir)
    part = F.pmod(F.xxhash64("stok_kodu", "donem"), F.lit(8)).alias("part")
    lines = cells.select(part, F.concat_ws(",", "stok_kodu", "cell", "donem").alias("line"), F.lit(1).alias("place"))
    heads = spark.range(8).select(
        F.col("id").alias("part"), F.lit("stok_kodu,urun_adi,donem").alias("line"), F.lit(0).alias("place")
    )
    path = new_path(spark, "broken_lines")
    ordered = lines.union(heads).repartition("part").sortWithinPartitions("part", "place")
    ordered.select("part", "line").write.partitionBy("part").text(path)
    return csv_scan.scan_csv(spark, f"{path}/*").rows.drop(csv_scan.SEQ)


# -- encoding -------------------------------------------------------------------
def turkish_names(spark, sf_dir):
    names = inventory_panel(spark, sf_dir).select(
        F.concat(F.lit("Döşemelik Ağır İş "), F.col("urun_adi")).alias("ad"), "donem"
    )
    return names.withColumn("part", F.lit(1))


def to_mojibake(x: str) -> str:
    """SQL: the text as it looks after its UTF-8 bytes were read as CP1252."""
    as_latin = f"decode(encode({x}, 'UTF-8'), 'ISO-8859-1')"
    return f"translate({as_latin}, '{enc.CONTROLS}', '{enc.CP1252_CHARS}')"


def encodings() -> dict[str, tuple[str, str]]:
    """kind of file -> (its text of a name, the writer's encoding)."""
    legacy = f"translate(ad, '{enc.TURKISH_SIX}', '{enc.LATIN1_SIX}')"
    kinds = {
        "utf8": ("ad", "UTF-8"),
        "cp1254": (legacy, "ISO-8859-1"),
        "mojibake": (to_mojibake("ad"), "UTF-8"),
        "mixed": (f"IF(donem < '1998', ad, {to_mojibake('ad')})", "UTF-8"),
    }
    return kinds


def write_encodings(spark, sf_dir, folder: str) -> str:
    """Three files of each kind; folder: where those of a kind go, below a new path."""
    names, root = store(turkish_names(spark, sf_dir), "turkish_names"), new_path(spark, "encodings")

    folders: dict[str, list] = {}
    for kind, (text, charset) in encodings().items():
        # every text as the Latin-1 characters of its bytes, so that one job writes a folder's files
        written = text if charset == "ISO-8859-1" else f"decode(encode({text}, '{charset}'), 'ISO-8859-1')"
        folders.setdefault(folder.format(kind=kind), []).append(names.repartition(3).selectExpr(f"{written} AS ad", "donem"))
    for to, parts in folders.items():
        reduce(DataFrame.union, parts).write.option("header", True).option("encoding", "ISO-8859-1").csv(f"{root}/{to}")
    return root


@register(
    "src06_encoding_audit",
    f"{sql.chain(sql.INVENTORY_PANEL)} SELECT kind, (SELECT count(*) FROM panel) AS rows, 3 AS files, "
    "encoding, verdict FROM (VALUES ('utf8', 'utf-8-sig', 'clean'), ('cp1254', 'cp1254', 'clean'), "
    "('mojibake', 'utf-8-sig', 'repaired'), ('mixed', 'utf-8-sig', 'suspect')) "
    "t(kind, encoding, verdict)",
)
def encoding_audit(spark, sf_dir):
    """Files in UTF-8, in CP1254, repairable and damaged beyond repair, told apart."""
    root = write_encodings(spark, sf_dir, "{kind}")
    audit = csv_scan.audit_files(spark, [f"{root}/{k}" for k in encodings()])
    kind = F.regexp_extract("file", "/([a-z0-9]+)/[^/]*$", 1).alias("kind")
    return audit.groupBy(kind, "encoding", "verdict").agg(
        (F.sum("lines") - F.count(F.lit(1))).alias("rows"), F.count(F.lit(1)).alias("files")
    )


PLACE = "Döşemelik Ağır İş "


@register(
    "src06_mixed_folder",
    f"{sql.chain(sql.INVENTORY_PANEL)}, named AS (SELECT '{PLACE}' || urun_adi AS ad, "
    f"CASE WHEN donem < '1998' THEN '{PLACE}' ELSE '{PLACE.encode().decode('cp1252')}' END || urun_adi AS kept, donem "
    "FROM panel), files AS (SELECT ad, donem FROM named UNION ALL SELECT ad, donem FROM named "
    "UNION ALL SELECT ad, donem FROM named UNION ALL SELECT kept, donem FROM named) "
    "SELECT ad, donem, count(*) AS n FROM files GROUP BY ALL",
)
def mixed_folder(spark, sf_dir):
    """Twelve files of four kinds in one folder, read by one scan."""
    scan = csv_scan.scan_csv(spark, f"{write_encodings(spark, sf_dir, 'all')}/all")
    return scan.rows.groupBy("ad", "donem").agg(F.count(F.lit(1)).alias("n"))


def count_sql(pattern: str, x: str) -> str:
    return f"len(regexp_extract_all({x}, '{pattern}'))"


# Fixed values, written out again for the oracles: scored letters, telltale pairs, lead letters.
SCORED = "[çğıöşüÇĞİÖŞÜâîû]"
PAIRS = "Ã¶|Ã¼|Ã§|Ã‡|Ã–|Ãœ|Ä±|Ä°|ÄŸ|Äž|ÅŸ|Åž"
LEADS = "[ÃÄÅÎÏ]"
# What CP1252 has at 0x80-0x9F, and the code points of those bytes.
WINDOWS = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"
WINDOWS_BYTES = (128, *range(130, 141), 142, *range(145, 157), 158, 159)


def score_sql(x: str) -> str:
    return f"({count_sql(SCORED, x)} - 2 * {count_sql(PAIRS, x)} - {count_sql(LEADS, x)})"


@register(
    "src07_mojibake_repair",
    f"""WITH bytes AS (SELECT doc_id, text, list_transform(range(strlen(text)), lambda i:
      ('0x' || substr(hex(encode(text)), 2 * i + 1, 2))::INT) AS b FROM documents),
    broken AS (SELECT doc_id, text, len(list_filter(b, lambda x: x IN (129, 141, 143, 144, 157))) = 0 AS reversible,
      translate(array_to_string(list_transform(b, lambda x: chr(x)), ''),
        '{"".join(map(chr, WINDOWS_BYTES))}', '{WINDOWS}') AS broken FROM bytes)
    SELECT doc_id, broken <> text AS was_broken, CASE WHEN regexp_matches(broken, '{PAIRS}') AND reversible
      AND {score_sql("text")} > {score_sql("broken")} THEN text ELSE broken END AS repaired FROM broken""",
)
def mojibake_repair(spark, sf_dir):
    """Documents damaged by a wrong codec, each repaired on its own where that is safe."""
    docs = table(spark, sf_dir, "documents")
    broken = docs.selectExpr("doc_id", "text", f"{to_mojibake('text')} AS broken")
    return broken.select(
        "doc_id", (F.col("broken") != F.col("text")).alias("was_broken"), enc.repair_mojibake("broken").alias("repaired")
    )


@register(
    "src08_mojibake_flags",
    f"SELECT doc_id, regexp_matches(text, '{PAIRS}') AS flagged FROM documents",
)
def mojibake_flags(spark, sf_dir):
    return table(spark, sf_dir, "documents").selectExpr(
        "doc_id", f"{enc.has_mojibake('text')} AS flagged"
    )


@register(
    "src09_turkish_score",
    f"SELECT doc_id, CAST({score_sql('text')} AS BIGINT) AS score FROM documents",
)
def turkish_scores(spark, sf_dir):
    return table(spark, sf_dir, "documents").selectExpr(
        "doc_id", f"bigint{enc.turkish_score('text')} AS score"
    )
