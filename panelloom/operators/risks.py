"""Risk rules over the entity summary, their order, filters and roll-ups."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, functions as F

from panelloom.functions.text import quoted, render
from panelloom.model import severity_rank
from panelloom.operators.quality import usable
from panelloom.operators.ranking import with_position
from panelloom.pack import Condition, ReportPack, Stage


def evidence_of(rule: Condition, pack: ReportPack) -> Column:
    """The rule's non-null metrics as an array of metric values."""
    items = []
    for name in rule.shows:
        label, unit = pack.describe(name)
        items.append(
            f"CASE WHEN `{name}` IS NOT NULL THEN named_struct('metric', '{name}', "
            f"'label', {quoted(label)}, 'value', double(`{name}`), 'unit', {quoted(unit)}, "
            f"'entity', `{pack.entity}`, 'period', string(NULL)) END"
        )
    return F.expr(f"array_compact(array({', '.join(items)}))")


def finding(rule: Condition, order: int, pack: ReportPack) -> Column:
    title, template, recommendation = pack.wording.findings[rule.code]
    impact = rule.worth(pack.panel) if rule.worth else F.lit(None)
    first_seen = f"string(`{rule.since}`)" if rule.since else "string(NULL)"
    narrative = rule.tells(pack.panel) if rule.tells else render(template)
    return F.struct(
        F.expr(f"{order} AS rule_no"),
        F.expr(f"{quoted(rule.code)} AS code"),
        F.expr(f"{quoted(title)} AS title"),
        F.expr(f"{quoted(rule.severity)} AS severity"),
        narrative.alias("narrative"),
        F.expr(f"{quoted(recommendation)} AS recommendation"),
        evidence_of(rule, pack).alias("evidence"),
        impact.cast("double").alias("financial_impact_tl"),
        F.expr(f"{first_seen} AS first_seen_period"),
    )


def usable_rules(entities: DataFrame, pack: ReportPack) -> list[tuple[Condition, Column]]:
    """The pack's rules with whether they hold for an entity-summary row; null counts as no.

    Those the summary cannot evaluate are logged: dropping one silently would read as "no risk".
    """
    rules = [(rule, rule.holds(pack.panel)) for rule in pack.found_at(Stage.ENTITY)]
    try:
        entities.select(*[holds for _, holds in rules])
        return rules
    except AnalysisException:
        kept = usable(entities, {rule.code: holds for rule, holds in rules})
        return [(rule, holds) for rule, holds in rules if rule.code in kept]


def risk_table(entities: DataFrame, pack: ReportPack) -> DataFrame:
    """One row per (entity, matching rule), from a single pass over the summary."""
    rules = usable_rules(entities, pack)
    hits = [F.when(holds, finding(rule, order, pack)) for order, (rule, holds) in enumerate(rules)]
    dims = ", ".join(f"'{d}', coalesce(`{d}`, '')" for d in pack.dimensions)
    exploded = entities.select(
        F.expr(f"`{pack.entity}` AS entity"),
        F.expr(f"coalesce(nullif(`{pack.label}`, ''), `{pack.entity}`) AS entity_label"),
        F.expr(f"map({dims}) AS dimensions"),
        F.explode(F.array_compact(F.array(*hits))).alias("hit"),
    )
    return exploded.select("hit.*", "entity", "entity_label", "dimensions")


def risk_onsets(entities: DataFrame, pack: ReportPack) -> DataFrame:
    """(code, first_seen_period) of every finding: the risk table without its texts."""
    hits = []
    for rule, holds in usable_rules(entities, pack):
        seen = f"string(`{rule.since}`)" if rule.since else "string(NULL)"
        item = F.expr(f"named_struct('code', {quoted(rule.code)}, 'first_seen_period', {seen})")
        hits.append(F.when(holds, item))
    return entities.select(F.explode(F.array_compact(F.array(*hits))).alias("hit")).select("hit.*")


def risk_order() -> list[Column]:
    """Severity, then impact (null as 0) from large to small, entity, rule."""
    return [
        severity_rank(F.col("severity")).asc(),
        F.coalesce("financial_impact_tl", F.lit(0.0)).desc(),
        F.col("entity").asc(),
        F.col("rule_no").asc(),
    ]


def ordered_risks(risks: DataFrame) -> DataFrame:
    return risks.orderBy(*risk_order())


def placed_risks(risks: DataFrame) -> DataFrame:
    """risks with their 0-based `position` in the risk order; no task sorts them all."""
    return with_position(risks, *risk_order())


def top_risks(risks: DataFrame, n: int = 8) -> DataFrame:
    if n < 1:
        raise ValueError("n must be at least 1")
    return ordered_risks(risks).limit(n)


def filter_risks(
    risks: DataFrame, severity: str | None = None, period: str | None = None
) -> DataFrame:
    if severity:
        risks = risks.filter(F.col("severity") == severity)
    if period:
        risks = risks.filter(F.col("first_seen_period") == period)
    return risks


def risks_of_period(risks: DataFrame, period: str) -> DataFrame:
    return risks.filter(F.col("first_seen_period") == period)


def severity_counts(risks: DataFrame) -> DataFrame:
    return risks.groupBy("severity").agg(F.count(F.lit(1)).alias("count"))


def code_counts(risks: DataFrame) -> DataFrame:
    return risks.groupBy("code").agg(F.count(F.lit(1)).alias("count"))


def risk_totals(risks: DataFrame) -> DataFrame:
    return risks.agg(
        F.count(F.lit(1)).alias("total"),
        F.round(F.coalesce(F.sum("financial_impact_tl"), F.lit(0.0)), 2).alias(
            "total_financial_impact_tl"
        ),
    )


def prioritised_entities(entities: DataFrame, pack: ReportPack, n: int = 40) -> DataFrame:
    """Risky entities first, then key order, at most n.

    An entity is risky if any rule matches its own summary row, so no join with
    the risk table is needed.
    """
    rules = usable_rules(entities, pack)
    risky = F.exists(F.array(*[holds for _, holds in rules]), lambda holds: F.coalesce(holds, F.lit(False)))
    return (
        entities.withColumn("risky", risky).orderBy(F.desc("risky"), F.asc(pack.entity)).limit(n)
    )
