"""Check quoted figures against every number of an analysis.

A claim is (claim_id, metric, entity, period, value); a fact is (metric, folded
entity, period, value). Entity or period null means the whole portfolio or the
whole span.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F, types as T

from panelloom.functions.text import fold_name
from panelloom.model import severity_rank
from panelloom.pack import ReportPack
from panelloom.plans.analyze import AnalysisResult
from panelloom.sources.storage import store

# Tolerances and texts of the verification.
RELATIVE_TOLERANCE = 0.02
ABSOLUTE_TOLERANCE = 0.51
ACCEPTABLE_RATIO = 0.8
NOT_FOUND = "Metrik hesaplanmış tablolarda bulunamadı."
DEVIATES = "Değer hesaplanan sayıdan sapıyor."

SALTS = 16  # claims without an entity share one key for each metric and period

_NONE = "CAST(NULL AS STRING)"


def _ordered(source: int, a: str = "0D", b: str = "0D", s1: str = "''", s2: str = "''") -> str:
    """Writing order of a fact: the last one written for a key is the fact."""
    return (
        f"struct({source} AS source, double({a}) AS a, double({b}) AS b, "
        f"string({s1}) AS s1, string({s2}) AS s2)"
    )


def _numbers(frame: DataFrame) -> list[str]:
    return [
        f.name
        for f in frame.schema.fields
        if isinstance(f.dataType, T.NumericType) and not f.name.startswith("__")
    ]


def _long(frame: DataFrame, ids: dict[str, str]) -> DataFrame:
    """Unpivot the numeric columns of a result table into (metric, value) rows."""
    names = _numbers(frame)
    keyed = frame.selectExpr(
        *[f"{e} AS __{k}" for k, e in ids.items()], *[f"double(`{n}`) AS `{n}`" for n in names]
    )
    return keyed.unpivot([f"__{k}" for k in ids], names, "metric", "value")


def _fact(frame: DataFrame, metric: str, entity: str, period: str, value: str, order: str):
    return frame.selectExpr(
        f"{metric} AS metric",
        f"{entity} AS entity",
        f"{period} AS period",
        f"double({value}) AS value",
        f"{order} AS written",
    )


def period_facts(result: AnalysisResult) -> list[DataFrame]:
    period = result.pack.period
    rows = _long(result.period_rows, {"p": f"nullif({period}, '')"})
    return [_fact(rows, "metric", _NONE, "__p", "value", _ordered(1, s1="__p"))]


def entity_facts(entities: DataFrame, pack: ReportPack) -> list[DataFrame]:
    rows = _long(entities, {"e": f"nullif({pack.entity}, '')"})
    return [_fact(rows, "metric", "__e", _NONE, "value", _ordered(2, s1="__e"))]


def dimension_facts(result: AnalysisResult) -> list[DataFrame]:
    pack = result.pack
    rank = " ".join(f"WHEN '{d}' THEN {i}" for i, d in enumerate(pack.dimensions))
    ids = {
        "d": f"CASE dimension {rank} END",
        "v": "nullif(dimension_value, '')",
        "p": f"nullif({pack.period}, '')",
    }
    rows = _long(result.dimension_rows, ids)
    order = _ordered(3, a="__d", s1="__v", s2="__p")
    return [
        _fact(rows, "metric", "__v", "__p", "value", order),
        _fact(rows, "metric", "__v", _NONE, "value", order),
    ]


def series_facts(series: DataFrame, pack: ReportPack) -> list[DataFrame]:
    rows = _long(series, {"e": f"nullif({pack.entity}, '')", "p": f"nullif({pack.period}, '')"})
    return [_fact(rows, "metric", "__e", "__p", "value", _ordered(4, s1="__e", s2="__p"))]


def headline_facts(result: AnalysisResult) -> list[DataFrame]:
    return [_fact(result.headline, "metric", _NONE, "period", "value", _ordered(5))]


def delta_facts(result: AnalysisResult) -> list[DataFrame]:
    """Metrics and movers of every period, each also without its period."""
    sides = "concat(metrics, movers_up, movers_down)"
    rows = result.deltas.selectExpr("period AS at", f"posexplode({sides}) AS (pos, item)")
    order = _ordered(6, s1="at", s2="lpad(pos, 6, '0')")
    return [
        _fact(rows, "item.metric", "item.entity", "coalesce(item.period, at)", "item.value", order),
        _fact(rows, "item.metric", "item.entity", _NONE, "item.value", order),
    ]


def risk_facts(result: AnalysisResult) -> list[DataFrame]:
    ranked = result.risks.withColumn("rank", severity_rank(F.col("severity"))).withColumn(
        "impact", F.coalesce("financial_impact_tl", F.lit(0.0))
    )
    order = _ordered(7, a="rank", b="-impact", s1="entity", s2="lpad(rule_no, 4, '0')")
    evidence = ranked.selectExpr("rank", "impact", "rule_no", "inline(evidence)")
    return [
        _fact(ranked, "'financial_impact_tl'", "entity", _NONE, "financial_impact_tl", order),
        _fact(evidence, "metric", "entity", "period", "value", order),
    ]


def last_written(facts: DataFrame) -> DataFrame:
    """One row per key: the fact written last."""
    return facts.groupBy("metric", "entity", "period").agg(
        F.max_by("value", "written").alias("value"), F.max("written").alias("written")
    )


def written_facts(result: AnalysisResult, claims: DataFrame | None = None) -> DataFrame:
    """Every computed number with its key and writing order.

    A key appears at most once per source: the summary sources, which write some
    keys once a period, are reduced here; series and entity rows are unique up to
    spelling and are by far the most, so they are not sorted again.

    With `claims`, only entities some claim names are unpivoted, and only figures whose
    metric some claim names go on.
    """
    pack = result.pack
    series, entities = result.series_rows, result.entity_rows
    metrics = None
    if claims is not None:
        named = claims.select(fold_name(F.col("entity")).alias("__named")).distinct()
        same = fold_name(F.col(pack.entity)) == F.col("__named")
        series = series.join(named, same, "left_semi")
        entities = entities.join(named, same, "left_semi")
        known = F.col("metric").isin(sorted({*_numbers(series), *_numbers(entities)}))
        # at most as many rows as the tables have columns
        metrics = F.broadcast(claims.filter(known).select(F.col("metric").alias("__metric")).distinct())
    summaries = [
        *period_facts(result),
        *dimension_facts(result),
        *headline_facts(result),
        *delta_facts(result),
        *risk_facts(result),
    ]
    rows = [*series_facts(series, pack), *entity_facts(entities, pack)]
    if metrics is not None:
        rows = [r.join(metrics, F.col("metric") == F.col("__metric"), "left_semi") for r in rows]
    return last_written(keyed(summaries)).unionByName(keyed(rows))


def keyed(parts: list[DataFrame]) -> DataFrame:
    """Stacked facts under their folded names, without empty values."""
    facts = reduce(DataFrame.unionByName, parts).filter(F.col("value").isNotNull())
    return facts.withColumn("entity", fold_name(F.col("entity")))


def fact_index(result: AnalysisResult, claims: DataFrame | None = None) -> DataFrame:
    """The whole index with one row per key."""
    return last_written(written_facts(result, claims))


def look_up(claims: DataFrame, facts: DataFrame) -> DataFrame:
    """Add `expected`: the value of the first key of the ladder that has one.

    The ladder tries (entity, period), the entity, the period, and the portfolio: the period
    is dropped before the entity, because an entity's own figure is closer than the
    portfolio's. `facts` may hold a key more than once; the one written last counts, so every
    claim meets at most one fact a rung. Facts without an entity, one for each metric and
    period, are sent to the claims; claims without an entity have no figure of an entity to
    find and are only spread over salts.
    """
    columns = claims.columns
    last = F.max_by("value", F.struct("written"))
    facts = store(
        facts.filter(F.col("value").isNotNull()).groupBy("metric", "entity", "period").agg(last.alias("value")), "facts"
    )
    claims = claims.withColumn("__entity", fold_name(F.col("entity")))
    salt = F.when(F.col("__entity").isNull(), F.pmod(F.xxhash64("claim_id"), F.lit(SALTS)))
    claims = claims.withColumn("__salt", F.coalesce(salt, F.lit(0)).cast("int"))
    for rung, (entity, period) in enumerate(((True, True), (True, False), (False, True), (False, False))):
        own = facts.filter(F.col("entity").isNotNull() if entity else F.col("entity").isNull())
        own = own if period else own.filter(F.col("period").isNull())
        own = own.select(
            F.col("metric").alias("f_metric"), F.col("entity").alias("f_entity"), F.col("period").alias("f_period"),
            F.col("value").alias(f"__value{rung}"), F.lit(0).alias("f_salt"),
        )
        same = F.col("metric") == F.col("f_metric")
        if entity:
            same &= (F.col("__entity") == F.col("f_entity")) & (F.col("__salt") == F.col("f_salt"))
        if period:
            same &= F.col("period").eqNullSafe(F.col("f_period"))
        claims = claims.join(own if entity else F.broadcast(own), same, "left").drop(*[c for c in own.columns if c[0] == "f"])
    return claims.select(*columns, F.coalesce(*[f"__value{rung}" for rung in range(4)]).alias("expected"))


def verify(claims: DataFrame, facts: DataFrame) -> DataFrame:
    """Per claim: expected value, verdict, and the reason when it fails."""
    tolerance = F.greatest(
        F.lit(ABSOLUTE_TOLERANCE), F.abs("expected") * F.lit(RELATIVE_TOLERANCE)
    )
    near = F.abs(F.col("value") - F.col("expected")) <= tolerance
    found = F.col("expected").isNotNull()
    return look_up(claims, facts).withColumns(
        {
            "verified": found & near,
            "reason": F.when(~found, NOT_FOUND).when(~near, DEVIATES),
        }
    )


def grounding_report(verified: DataFrame) -> DataFrame:
    """One row: totals, share verified (1.0 for no claims), verdict, first 20 issues."""
    counts = verified.agg(
        F.count(F.lit(1)).alias("total_evidence"),
        F.count_if("verified").alias("verified_evidence"),
    )
    ratio = F.when(
        F.col("total_evidence") > 0, F.col("verified_evidence") / F.col("total_evidence")
    ).otherwise(1.0)
    listed = first_issues(verified).agg(
        F.sort_array(F.collect_list(F.struct(*ISSUE_FIELDS))).alias("issues")
    )
    return counts.select(
        "total_evidence",
        "verified_evidence",
        F.bround(ratio, 4).alias("grounding_ratio"),
        (ratio >= ACCEPTABLE_RATIO).alias("is_acceptable"),
        listed.scalar().alias("issues"),
    )


ISSUE_FIELDS = ("claim_id", "metric", "entity", "period", "value", "expected", "reason")


def first_issues(verified: DataFrame, n: int = 20) -> DataFrame:
    """The first n failed claims in claim order."""
    return verified.filter(~F.col("verified")).orderBy("claim_id").limit(n).select(*ISSUE_FIELDS)


# -- evidence inside nested documents ---------------------------------------------
EVIDENCE = "array<struct<metric:string,value:double,unit:string,entity:string,period:string>>"
ACTIONS = (
    "array<struct<priority:string,title:string,rationale:string,"
    f"evidence:{EVIDENCE},owner:string,horizon:string,expected_impact_tl:double>>"
)
HIGHLIGHTS = f"array<struct<entity:string,title:string,why_it_matters:string,evidence:{EVIDENCE}>>"
# Fields that carry evidence, in document order: a period analysis has actions, a
# summary has the middle three, an answer has evidence of its own.
PAYLOAD = (
    f"actions {ACTIONS}, top_risks {HIGHLIGHTS}, opportunities {HIGHLIGHTS}, "
    f"strategic_actions {ACTIONS}, evidence {EVIDENCE}"
)
CARRIERS = ("actions", "top_risks", "opportunities", "strategic_actions")


def collect_evidence(documents: DataFrame, doc_id: str, payload: str) -> DataFrame:
    """One row per evidence item of JSON documents, in document order."""
    parsed = documents.select(doc_id, F.from_json(payload, PAYLOAD).alias("__payload"))
    nested = [
        f"flatten(transform(coalesce(__payload.{c}, array()), x -> coalesce(x.evidence, array())))"
        for c in CARRIERS
    ]
    lists = [f"coalesce({x}, array())" for x in (*nested, "__payload.evidence")]
    return parsed.selectExpr(doc_id, f"posexplode(concat({', '.join(lists)})) AS (pos, item)").select(
        doc_id, "pos", "item.*"
    )


def document_reports(
    documents: DataFrame, doc_id: str, payload: str, facts: DataFrame, issues: int = 20
) -> DataFrame:
    """The grounding report of every JSON document: its evidence collected, looked up and judged.

    One row per document, also for those without evidence (share 1.0, acceptable). Issues are
    the first failed items in document order; their limit runs before the exchange, so a
    document with most of the evidence sends `issues` rows per task. Documents with one id are
    one document.
    """
    named = documents.select(F.col(doc_id).cast("string").alias("doc"), F.col(payload).alias("payload"))
    items = collect_evidence(named, "doc", "payload")
    claim = F.concat_ws("#", F.coalesce("doc", F.lit("")), F.lpad("pos", 6, "0"))
    judged = store(verify(items.withColumn("claim_id", claim), facts), "judged_evidence")
    totals = judged.groupBy("doc").agg(
        F.count(F.lit(1)).alias("total"), F.count_if("verified").alias("verified")
    )
    in_order = Window.partitionBy("doc").orderBy("pos", "claim_id")
    failed = judged.filter(~F.col("verified")).withColumn("nth", F.row_number().over(in_order)).filter(F.col("nth") <= issues)
    fields = F.struct("nth", *[f for f in ISSUE_FIELDS if f != "claim_id"])
    listed = failed.groupBy("doc").agg(F.sort_array(F.collect_list(fields)).alias("listed"))
    ratio = F.when(F.col("total") > 0, F.col("verified") / F.col("total")).otherwise(1.0)
    known = named.select("doc").distinct()
    for side in (totals, listed):
        side = side.withColumnRenamed("doc", "of")
        known = known.join(side, F.col("doc").eqNullSafe(F.col("of")), "left").drop("of")
    known = known.withColumn("total", F.coalesce("total", F.lit(0).cast("long")))
    return known.select(
        F.col("doc").alias(doc_id),
        F.col("total").alias("total_evidence"),
        F.coalesce("verified", F.lit(0).cast("long")).alias("verified_evidence"),
        F.bround(ratio, 4).alias("grounding_ratio"),
        (ratio >= ACCEPTABLE_RATIO).alias("is_acceptable"),
        F.transform(F.coalesce("listed", F.array()), lambda i: i.dropFields("nth")).alias("issues"),
    )


def without_evidence(documents: DataFrame, doc_id: str, payload: str) -> DataFrame:
    """Actions and highlights that carry no evidence; there should be none."""
    parsed = documents.select(doc_id, F.from_json(payload, PAYLOAD).alias("__payload"))
    bare = ", ".join(
        f"transform(filter(coalesce(__payload.{c}, array()), x -> coalesce(size(x.evidence), 0) <= 0), "
        f"x -> struct('{c}' AS part, x.title AS title))"
        for c in CARRIERS
    )
    return parsed.selectExpr(doc_id, f"inline(concat({bare}))")
