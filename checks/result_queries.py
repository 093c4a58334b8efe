"""Registered queries of grounding, ledger, call log and user-facing results."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import analysis_queries as aq, oracle_panels as sql
from checks.ingest_queries import ISSUE_SQL, PENALTY_SQL, write_export
from checks.shape import NUDGE, rounded, tidy
from checks.star_panels import campaign_panel, inventory_panel, table
from panelloom.functions.text import fold_name
from panelloom.operators import call_log, grounding
from panelloom.pack import Stage
from panelloom.packs import campaigns, inventory
from panelloom.plans import results
from panelloom.plans.analyze import analyze
from panelloom.plans.ingest import ingest
from panelloom.sources import ledger
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


# -- grounding ------------------------------------------------------------------

def claims_of(result):
    """One claim per entity on its last stock, its mean outflow and its margin by month."""
    entities = result.entity_rows
    key = F.col("stok_kodu").cast("bigint")
    wrong = F.when(key % 3 == 0, 1.1).otherwise(1.0)
    stock = entities.select(
        F.concat(F.lit("A"), "stok_kodu").alias("claim_id"),
        F.lit("son_stok").alias("metric"),
        F.concat(F.lit(" "), "stok_kodu").alias("entity"),
        F.lit(None).cast("string").alias("period"),
        (F.col("son_stok") * wrong + 0.4).alias("value"),
    )
    # no mean outflow by month exists, so the period is dropped on the ladder
    mean = entities.select(
        F.concat(F.lit("B"), "stok_kodu").alias("claim_id"),
        F.when(key % 5 == 0, "made_up").otherwise("ortalama_cikis").alias("metric"),
        F.col("stok_kodu").alias("entity"),
        F.lit("1999-01").alias("period"),
        F.col("ortalama_cikis").alias("value"),
    )
    # an unknown entity falls through to the portfolio of the month
    portfolio = result.period_rows.select(
        F.concat(F.lit("C"), "donem").alias("claim_id"),
        F.lit("toplam_ciro_tl").alias("metric"),
        F.lit("nobody").alias("entity"),
        F.col("donem").alias("period"),
        F.col("toplam_ciro_tl").alias("value"),
    )
    # a region without a month holds its last month; upper case must not matter
    places = result.dimension_rows.filter("dimension = 'depo'")
    region = places.select(
        F.concat(F.lit("D"), "dimension_value", F.lit("-"), "donem").alias("claim_id"),
        F.lit("toplam_cikis").alias("metric"),
        F.lower("dimension_value").alias("entity"),
        F.lit(None).cast("string").alias("period"),
        F.col("toplam_cikis").alias("value"),
    )
    flow = result.series_rows.select(
        F.concat(F.lit("E"), "stok_kodu", F.lit("-"), "donem").alias("claim_id"),
        F.lit("giris_miktar").alias("metric"),
        F.col("stok_kodu").alias("entity"),
        F.col("donem").alias("period"),
        F.col("giris_miktar").alias("value"),
    )
    return stock.unionByName(mean).unionByName(portfolio).unionByName(region).unionByName(flow)


GROUND_SQL = f"""{sql.chain(*sql.INVENTORY)}{aq.INV_TOTALS}{aq.INV_DIMS}, expected AS (
  SELECT 'A' || stok_kodu AS claim_id, 'son_stok' AS metric,
    son_stok * CASE WHEN CAST(stok_kodu AS BIGINT) % 3 = 0 THEN 1.1 ELSE 1.0 END + 0.4 AS value,
    son_stok AS expected FROM entities
  UNION ALL SELECT 'B' || stok_kodu, CASE WHEN CAST(stok_kodu AS BIGINT) % 5 = 0 THEN 'made_up'
      ELSE 'ortalama_cikis' END, ortalama_cikis,
    CASE WHEN CAST(stok_kodu AS BIGINT) % 5 <> 0 THEN ortalama_cikis END FROM entities
  UNION ALL SELECT 'C' || donem, 'toplam_ciro_tl', toplam_ciro_tl, toplam_ciro_tl FROM totals
  UNION ALL SELECT 'D' || dimension_value || '-' || donem, 'toplam_cikis', toplam_cikis,
    last_value(toplam_cikis) OVER (PARTITION BY dimension_value ORDER BY donem
      ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) FROM dims WHERE dimension = 'depo'
  UNION ALL SELECT 'E' || stok_kodu || '-' || donem, 'giris_miktar', giris_miktar, giris_miktar
    FROM series),
judged AS (
  SELECT *, coalesce(abs(value - expected) <= greatest(0.51, abs(expected) * 0.02), false)
    AS verified FROM expected)
"""


def checked_claims(spark, sf_dir):
    result = analyze(inventory_panel(spark, sf_dir), INV)
    claims = store(claims_of(result), "claims")
    return grounding.verify(claims, grounding.written_facts(result, claims))


@register(
    "grd03_04_verified_claims",
    f"{GROUND_SQL} SELECT claim_id, metric, {rounded('value expected')}, verified, "
    f"CASE WHEN expected IS NULL THEN '{grounding.NOT_FOUND}' WHEN NOT verified THEN "
    f"'{grounding.DEVIATES}' END AS reason FROM judged",
)
def verified_claims(spark, sf_dir):
    found = checked_claims(spark, sf_dir)
    return tidy(found.select("claim_id", "metric", "value", "expected", "verified", "reason"))


@register(
    "grd05_grounding_report",
    f"{GROUND_SQL} SELECT count(*) AS total_evidence, count(*) FILTER (verified) AS "
    f"verified_evidence, round(count(*) FILTER (verified) / count(*) + {NUDGE}, 4) + 0.0 AS "
    "grounding_ratio, count(*) FILTER (verified) / count(*) >= 0.8 AS is_acceptable, "
    "least(20, count(*) FILTER (NOT verified)) AS issue_count FROM judged",
)
def grounding_report(spark, sf_dir):
    report = grounding.grounding_report(checked_claims(spark, sf_dir))
    return tidy(report.selectExpr("* EXCEPT (issues)", "size(issues) AS issue_count"))


def claim_documents(claims):
    """One JSON document per entity or month: an action, an opportunity and evidence of its own."""
    item = F.struct("metric", "value", F.lit("adet").alias("unit"), "entity", "period")
    kind = F.left("claim_id", F.lit(1))
    listed = {k: F.collect_list(F.when(kind == k, item)) for k in "ABCDE"}
    docs = claims.groupBy(F.substring("claim_id", 2, 40).alias("doc")).agg(*[v.alias(k) for k, v in listed.items()])
    payload = F.to_json(F.struct(
        F.array(F.struct(F.lit("yuksek").alias("priority"), F.lit("t").alias("title"), F.col("A").alias("evidence"))).alias("actions"),
        F.array(F.struct(F.lit("t").alias("title"), F.col("E").alias("evidence"))).alias("top_risks"),
        F.array(F.struct(F.lit("t").alias("title"), F.col("B").alias("evidence"))).alias("opportunities"),
        F.array(F.struct(F.lit("t").alias("title"), F.col("D").alias("evidence"))).alias("strategic_actions"),
        F.col("C").alias("evidence"),
    ))
    empty = claims.sparkSession.range(1).select(F.lit("none").alias("doc"), F.lit('{"actions": []}').alias("payload"))
    return docs.select("doc", payload.alias("payload")).union(empty)


@register(
    "grd03_06_document_reports",
    f"{GROUND_SQL}, by_doc AS (SELECT substr(claim_id, 2) AS doc, claim_id, metric, expected, verified FROM judged) "
    "SELECT doc, count(*) AS total_evidence, count(*) FILTER (verified) AS verified_evidence, "
    f"round(count(*) FILTER (verified) / count(*) + {NUDGE}, 4) + 0.0 AS grounding_ratio, "
    "count(*) FILTER (verified) / count(*) >= 0.8 AS is_acceptable, coalesce(string_agg(metric || ':' || "
    f"CASE WHEN expected IS NULL THEN '{grounding.NOT_FOUND}' ELSE '{grounding.DEVIATES}' END, '; ' ORDER BY claim_id) "
    "FILTER (NOT verified), '') AS issues FROM by_doc GROUP BY doc UNION ALL SELECT 'none', 0, 0, 1.0, true, ''",
)
def document_reports(spark, sf_dir):
    """Documents with evidence in their parts, each with its own report."""
    result = analyze(inventory_panel(spark, sf_dir), INV)
    claims = store(claims_of(result), "claims")
    facts = grounding.written_facts(result, claims)
    documents = store(claim_documents(claims), "claim_documents")
    reports = grounding.document_reports(documents, "doc", "payload", facts)
    issues = F.array_join(F.transform("issues", lambda i: F.concat_ws(":", i["metric"], i["reason"])), "; ")
    return tidy(reports.withColumn("issues", issues))


@register(
    "grd01_fact_index_series_part",
    f"{sql.chain(sql.INVENTORY_PANEL, sql.INVENTORY_SERIES)} SELECT metric, entity, period, "
    f"{rounded('value')} FROM (UNPIVOT (SELECT stok_kodu AS entity, donem AS period, giris_miktar, "
    "cikis_miktar, donem_sonu_stok, ciro_tl, kapama_ay, marj_yuzde FROM series) ON giris_miktar, "
    "cikis_miktar, donem_sonu_stok, ciro_tl, kapama_ay, marj_yuzde INTO NAME metric VALUE value) "
    "WHERE value IS NOT NULL",
)
def fact_index(spark, sf_dir):
    result = analyze(inventory_panel(spark, sf_dir), INV)
    chosen = ("giris_miktar", "cikis_miktar", "donem_sonu_stok", "ciro_tl", "kapama_ay", "marj_yuzde")
    facts = grounding.fact_index(result)
    both = F.col("entity").isNotNull() & F.col("period").isNotNull()
    chosen_facts = facts.filter(both & F.col("metric").isin(*chosen))
    return tidy(chosen_facts.drop("written"))


@register(
    "grd01_fact_index_last_written",
    f"{sql.chain(*sql.INVENTORY)}{aq.INV_TOTALS}{aq.INV_DIMS} "
    f"SELECT 'toplam_cikis' AS metric, lower(dimension_value) AS entity, {rounded('value')} FROM "
    "(SELECT dimension_value, last(toplam_cikis ORDER BY donem) AS value FROM dims GROUP BY 1) "
    f"UNION ALL SELECT 'toplam_ciro_tl', NULL, {rounded('value')} FROM "
    "(SELECT last(toplam_ciro_tl ORDER BY donem) AS value FROM totals)",
)
def last_written(spark, sf_dir):
    """Facts without a period: a dimension's last month, the portfolio's last month."""
    result = analyze(inventory_panel(spark, sf_dir), INV)
    facts = grounding.fact_index(result).filter("period IS NULL")
    named = facts.filter("metric = 'toplam_cikis' AND entity IS NOT NULL")
    whole = facts.filter("metric = 'toplam_ciro_tl' AND entity IS NULL")
    return tidy(named.unionByName(whole).select("metric", "entity", "value"))


@register(
    "grd02_folded_names",
    "SELECT c_custkey, lower(c_mktsegment) || ' gus' AS folded FROM customer",
)
def folded_names(spark, sf_dir):
    name = F.concat(F.lit(" "), "c_mktsegment", F.lit(" ğÜş \t"))
    return table(spark, sf_dir, "customer").select("c_custkey", fold_name(name).alias("folded"))


def documents_json(spark, sf_dir):
    """One JSON answer per conversation: each assistant turn is an action with evidence."""
    turns = table(spark, sf_dir, "conversations")
    item = F.struct(
        F.lit("text_length").alias("metric"),
        F.length("text").cast("double").alias("value"),
        F.lit("sayi").alias("unit"),
        F.col("role").alias("entity"),
        F.lit(None).cast("string").alias("period"),
    )
    bare = F.col("turn") % 3 == 2
    action = F.struct(
        F.lpad(F.col("turn").cast("string"), 8, "0").alias("title"),
        F.when(bare, F.array().cast(f"array<{ITEM}>")).otherwise(F.array(item)).alias("evidence"),
    )
    # one row per turn, so a long conversation is never gathered in one place
    return turns.select(
        F.concat_ws("-", "conv_id", "turn").alias("doc"),
        F.to_json(F.struct(F.array(action).alias("actions"))).alias("payload"),
    )


ITEM = "struct<metric:string,value:double,unit:string,entity:string,period:string>"


@register(
    "grd06_collected_evidence",
    "SELECT conv_id || '-' || turn AS doc, 0 AS pos, 'text_length' AS metric, "
    "CAST(length(text) AS DOUBLE) AS value, role AS entity FROM conversations WHERE turn % 3 <> 2",
)
def collected_evidence(spark, sf_dir):
    found = grounding.collect_evidence(documents_json(spark, sf_dir), "doc", "payload")
    return tidy(found.select("doc", "pos", "metric", "value", "entity"))


@register(
    "grd07_actions_without_evidence",
    "SELECT conv_id || '-' || turn AS doc, 'actions' AS part, "
    "lpad(CAST(turn AS VARCHAR), 8, '0') AS title FROM conversations WHERE turn % 3 = 2",
)
def bare_actions(spark, sf_dir):
    return grounding.without_evidence(documents_json(spark, sf_dir), "doc", "payload")


# -- call log -------------------------------------------------------------------
PRICES = {"system": (5.0, 25.0), "user": (2.0, 10.0)}


@register(
    "agg14_call_log_rollup",
    f"""WITH calls AS (
  SELECT conv_id AS run, length(text) AS i, turn AS o, length(text) // 2 AS w,
    CASE WHEN turn > 0 THEN length(text) * 3 ELSE 0 END AS r,
    CASE role WHEN 'system' THEN 5.0 WHEN 'user' THEN 2.0 ELSE 5.0 END AS price_in,
    CASE role WHEN 'system' THEN 25.0 WHEN 'user' THEN 10.0 ELSE 25.0 END AS price_out
  FROM conversations)
SELECT run, count(*) AS call_count, CAST(sum(i) AS BIGINT) AS input_tokens,
  CAST(sum(o) AS BIGINT) AS output_tokens, CAST(sum(w) AS BIGINT) AS cache_write_tokens,
  CAST(sum(r) AS BIGINT) AS cache_read_tokens, count(*) FILTER (r > 0) AS cache_hit_calls,
  round(round_even(sum(CAST(i * price_in + o * price_out + w * price_in * 1.25 + r * price_in * 0.1 AS DOUBLE))
    / 1000000, 5) + {NUDGE}, 4) + 0.0 AS total_cost_usd, CAST(sum(i * 10) AS BIGINT) AS duration_ms
FROM calls GROUP BY run""",
)
def call_rollup(spark, sf_dir):
    text = F.length("text").cast("bigint")
    calls = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("run"),
        F.col("role").alias("model"),
        text.alias("input_tokens"),
        F.col("turn").alias("output_tokens"),
        F.floor(text / 2).alias("cache_write_tokens"),
        F.when(F.col("turn") > 0, text * 3).otherwise(0).alias("cache_read_tokens"),
        (text * 10).alias("duration_ms"),
    )
    return tidy(call_log.run_statistics(calls, PRICES))


# -- ledger ---------------------------------------------------------------------
def stored_ledger(spark, sf_dir) -> str:
    """A ledger with one dataset per document; every seventh is deleted again."""
    path = new_path(spark, "ledger")
    docs = table(spark, sf_dir, "documents")
    records = docs.select(
        F.format_string("d%08d", "doc_id").alias("dataset_id"),
        F.concat("source", F.lit(".csv")).alias("filename"),
        F.when(F.col("doc_id") % 2 == 0, INV.key).otherwise(CMP.key).alias("pack_key"),
        F.sha2("text", 256).alias("content_hash"),
        F.col("n_chars").alias("raw_row_count"),
        (F.col("n_chars") % 101).alias("health_score"),
        F.timestamp_seconds(F.col("doc_id") * 60).alias("created_at"),
    )
    ledger.append(records, path)
    gone = docs.filter("doc_id % 7 = 0").select(
        F.format_string("d%08d", "doc_id").alias("dataset_id")
    )
    ledger.delete(gone, path)
    return path


LEDGER_SQL = f"""WITH ledger AS (
  SELECT 'd' || lpad(CAST(doc_id AS VARCHAR), 8, '0') AS dataset_id, source || '.csv' AS filename,
    CASE WHEN doc_id % 2 = 0 THEN '{INV.key}' ELSE '{CMP.key}' END AS pack_key,
    sha256(text) AS content_hash, n_chars AS raw_row_count,
    CAST(n_chars % 101 AS BIGINT) AS health_score, doc_id
  FROM documents)
"""
LEDGER_COLUMNS = "dataset_id, filename, pack_key, content_hash, raw_row_count, health_score"


@register(
    "src10_src13_ledger_after_delete",
    f"{LEDGER_SQL} SELECT {LEDGER_COLUMNS} FROM ledger WHERE doc_id % 7 <> 0",
)
def ledger_rows(spark, sf_dir):
    rows = ledger.read(spark, stored_ledger(spark, sf_dir))
    return tidy(rows.select(*LEDGER_COLUMNS.split(", ")))


@register(
    "src11_newest_datasets",
    f"{LEDGER_SQL} SELECT {LEDGER_COLUMNS} FROM ledger WHERE doc_id % 7 <> 0 "
    "ORDER BY doc_id DESC LIMIT 50",
)
def newest(spark, sf_dir):
    rows = ledger.newest(spark, stored_ledger(spark, sf_dir))
    return tidy(rows.select(*LEDGER_COLUMNS.split(", ")))


@register(
    "src12_lookup_by_hash",
    f"{LEDGER_SQL} SELECT {LEDGER_COLUMNS} FROM ledger WHERE doc_id % 7 <> 0 AND "
    f"pack_key = '{CMP.key}' AND content_hash = (SELECT sha256(text) FROM documents "
    "WHERE doc_id = 1)",
)
def lookup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    wanted = docs.filter("doc_id = 1").select(F.sha2("text", 256)).first()[0]
    rows = ledger.by_hash(spark, stored_ledger(spark, sf_dir), wanted, CMP.key)
    return tidy(rows.select(*LEDGER_COLUMNS.split(", ")))


@register(
    "src12_not_yet_ingested",
    f"{LEDGER_SQL}, kept AS (SELECT * FROM ledger WHERE doc_id % 7 <> 0) "
    "SELECT doc_id, content_hash, pack_key FROM ledger l WHERE NOT EXISTS (SELECT 1 FROM kept k "
    "WHERE k.content_hash = l.content_hash AND k.pack_key = l.pack_key)",
)
def not_ingested(spark, sf_dir):
    candidates = table(spark, sf_dir, "documents").select(
        "doc_id",
        F.sha2("text", 256).alias("content_hash"),
        F.when(F.col("doc_id") % 2 == 0, INV.key).otherwise(CMP.key).alias("pack_key"),
    )
    rows = ledger.read(spark, stored_ledger(spark, sf_dir))
    return ledger.not_ingested(candidates, rows)


def merged_sql(digest: str) -> str:
    parts = ", ".join(f"sum(('0x' || substr({digest}, {at}, 16))::UBIGINT::HUGEINT)" for at in ledger.PARTS)
    return f"sha256(concat_ws('-', {parts}))"


@register(
    "src10_content_digest",
    "WITH lines AS (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS line, "
    "generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents), "
    "hashed AS (SELECT source, sha256(doc_id || '/' || i || ':' || line) AS h FROM lines) "
    f"SELECT source, count(*) AS lines, {merged_sql('h')} AS digest FROM hashed GROUP BY source",
)
def content_digests(spark, sf_dir):
    """What the lines of all documents of a source are, in their order, whatever the partitions."""
    lines = table(spark, sf_dir, "documents").select(
        "source", "doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line")
    )
    place = F.concat_ws("/", "doc_id", "i")
    return lines.groupBy("source").agg(
        F.count(F.lit(1)).alias("lines"),
        ledger.merged(ledger.line_digest(place, F.col("line"))).alias("digest"),
    )


@register(
    "src10_src12_recorded_ingest",
    f"""{ISSUE_SQL}, penalty AS ({PENALTY_SQL})
SELECT kind, '{INV.key}' AS pack_key, (SELECT count(*) FROM typed) AS raw_row_count,
  (SELECT count(*) FROM checked WHERE complete) AS clean_row_count,
  (SELECT count(*) FROM checked WHERE NOT complete) AS quarantined_row_count,
  CAST(greatest(0, least(100, round_even(100 - p, 0))) AS BIGINT) AS health_score, again, n_issues
FROM (SELECT p, issue_count AS n_issues FROM penalty), (VALUES ('first', 0), ('second', 1)) t(kind, again)""",
)
def recorded_ingest(spark, sf_dir):
    """Two uploads of one export in the ledger of a real ingest, told to be the same content."""
    path, store = write_export(spark, sf_dir), new_path(spark, "ledger")
    outcome, ids = ingest(spark, path), {}
    candidate = ledger.content_digest(spark, path).select("content_hash", F.lit(INV.key).alias("pack_key"))
    for kind in ("first", "second"):
        known = ids and ledger.not_ingested(candidate, ledger.read(spark, store)).isEmpty()
        ids[results.record_dataset(outcome, path, f"{kind}.csv", store)] = (kind, int(bool(known)))
    names = spark.createDataFrame([(i, *k) for i, k in ids.items()], "dataset_id string, kind string, again bigint")
    issues = F.size(F.from_json(F.get_json_object("quality_json", "$.issues"), "array<string>"))
    rows = ledger.read(spark, store).join(names, "dataset_id").withColumn("n_issues", issues)
    return tidy(rows.select(
        "kind", "pack_key", "raw_row_count", "clean_row_count", "quarantined_row_count", "health_score", "again", "n_issues"
    ))


# -- user-facing tables ---------------------------------------------------------
def analysed(spark, sf_dir):
    return analyze(inventory_panel(spark, sf_dir), INV)


@register(
    "qry01_overview",
    f"{sql.chain(*sql.INVENTORY, sql.INVENTORY_RISKS)}{aq.INV_TOTALS} "
    "SELECT 'periods' AS part, CAST(count(*) AS BIGINT) AS size FROM totals "
    "UNION ALL SELECT 'entity_count', count(*) FROM entities "
    "UNION ALL SELECT 'headline_metrics', 5 FROM totals GROUP BY ALL HAVING count(*) > 0 "
    "UNION ALL SELECT 'period_rows', count(*) FROM totals "
    "UNION ALL SELECT 'risk_counts_by_severity', count(DISTINCT severity) FROM risks "
    "UNION ALL SELECT 'top_risks', least(8, count(*)) FROM risks",
)
def overview(spark, sf_dir):
    """Row counts of the overview's tables; the entity count by its value."""
    tables = results.overview(analysed(spark, sf_dir))
    counts = []
    for name, frame in tables.items():
        size = F.max("entity_count") if name == "entity_count" else F.count(F.lit(1))
        counts.append(frame.agg(F.lit(name).alias("part"), size.alias("size")))
    whole = counts[0]
    for more in counts[1:]:
        whole = whole.unionByName(more)
    return whole


@register(
    "qry02_period_tables",
    f"{aq.INV_CHAIN}{aq.INV_TOTALS}{aq.INV_DIMS} SELECT 'dimension_rows' AS part, count(*) AS size "
    "FROM dims UNION ALL SELECT 'rows', count(*) FROM totals "
    "UNION ALL SELECT 'deltas', count(*) FROM totals UNION ALL SELECT 'periods', count(*) FROM totals",
)
def period_tables(spark, sf_dir):
    tables = results.period_tables(analysed(spark, sf_dir))
    counts = [
        frame.agg(F.lit(name).alias("part"), F.count(F.lit(1)).alias("size"))
        for name, frame in tables.items()
    ]
    return counts[0].unionByName(counts[1]).unionByName(counts[2]).unionByName(counts[3])


@register(
    "qry03_entity_rows",
    f"{aq.INV_ENT} SELECT stok_kodu, urun_adi, {rounded(aq.INV_ENT_D)} FROM entities",
)
def entity_rows(spark, sf_dir):
    rows = results.entity_tables(analysed(spark, sf_dir))["rows"]
    return tidy(rows.select("stok_kodu", "urun_adi", *aq.INV_ENT_D.split()))


def column_sql() -> str:
    texts = [("stok_kodu", "Kod", ""), ("urun_adi", "Ad", "")]
    texts += [("kategori", "Kategori", ""), ("depo", "Depo", "")]
    texts += [(a.name, *INV.describe(a.name)) for a in INV.at(Stage.ENTITY) if a.name not in INV.hidden]
    return " UNION ALL ".join(
        f"SELECT {i} AS position, '{n}' AS name, '{label}' AS label, '{unit}' AS unit, "
        f"count({n}) AS filled FROM entities"
        for i, (n, label, unit) in enumerate(texts)
    )


@register("qry03_entity_columns", f"{aq.INV_ENT} {column_sql()}")
def entity_columns(spark, sf_dir):
    """Column metadata with the number of filled cells of each column."""
    tables = results.entity_tables(analysed(spark, sf_dir), include_series=False)
    rows, columns = tables["rows"], tables["columns"]
    filled = rows.agg(*[F.count(c).alias(c) for c in rows.columns])
    counts = filled.unpivot([], filled.columns, "name", "filled")
    return columns.join(counts, "name").select("position", "name", "label", "unit", "filled")


@register(
    "qry04_filtered_risk_tables",
    f"{aq.CMP_RSK} SELECT code, count(*) AS count FROM risks WHERE severity = 'orta' GROUP BY code",
)
def filtered_risks(spark, sf_dir):
    result = analyze(campaign_panel(spark, sf_dir), CMP)
    return results.risk_tables(result, severity="orta")["by_code"]


def found_sql(chain: str, key: str) -> str:
    return (
        f"({chain} SELECT '{key}' AS key, (SELECT count(*) FROM entities) AS entities, count(*) AS findings, "
        "count(DISTINCT code) AS rules_met FROM risks)"
    )


@register(
    "qry06_pack_catalogue",
    f"WITH found AS (SELECT * FROM {found_sql(aq.INV_RSK, INV.key)} UNION ALL SELECT * FROM {found_sql(aq.CMP_RSK, CMP.key)}) "
    "SELECT key, title, risk_rule_count, metric_count, entities, findings, rules_met FROM "
    "(VALUES ('inventory', 'Stok ve Satış Raporu', 10, 14), ('campaigns', 'Reklam Performans Raporu', 7, 12)) "
    "t(key, title, risk_rule_count, metric_count) JOIN found USING (key)",
)
def catalogue(spark, sf_dir):
    """The report types with what their rules find in the panel each of them describes."""
    found = []
    for pack in (INV, CMP):
        rows, entities = aq.risks_of(pack, spark, sf_dir), aq.entities_of(pack, spark, sf_dir)
        found.append(rows.agg(
            F.lit(pack.key).alias("key"),
            F.count(F.lit(1)).alias("findings"),
            F.count_distinct("code").alias("rules_met"),
        ).withColumn("entities", entities.agg(F.count(F.lit(1))).scalar()))
    shown = results.pack_catalogue(spark).select("key", "title", "risk_rule_count", "metric_count")
    return tidy(shown.join(found[0].unionByName(found[1]), "key"))
