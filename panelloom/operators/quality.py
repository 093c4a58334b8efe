"""Completeness, quarantine, integrity rules, and the health score."""

from __future__ import annotations

import logging
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from panelloom.functions.panel import Panel
from panelloom.functions.text import sample_sql
from panelloom.model import RESOLVED_ACTIONS, RESOLVED_FACTOR, severity_rank, severity_weight
from panelloom.operators.impute import FLAG
from panelloom.pack import ReportPack, Stage

log = logging.getLogger(__name__)


def is_complete(pack: ReportPack, columns) -> Column:
    present = [F.col(c).isNotNull() for c in pack.required if c in columns]
    return reduce(lambda a, b: a & b, present, F.lit(True))


def quarantine(panel: DataFrame, pack: ReportPack) -> tuple[DataFrame, DataFrame]:
    """(clean rows, rows with a required value still missing)."""
    complete = is_complete(pack, panel.columns)
    return panel.filter(complete), panel.filter(~complete)


#: Periods of one bitmap word.
WORD = 64


def period_number(period: Column) -> Column:
    """YYYY-MM as YYYYMM, so that a year's months lie in one or two bitmap words."""
    return F.replace(period, F.lit("-"), F.lit("")).cast("long")


def period_bitmaps(panel: DataFrame, pack: ReportPack, *keys: str) -> DataFrame:
    """keys, word, bits: the periods present, as 64-bit words merged map-side by a bitwise or."""
    number = period_number(F.col(pack.period))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (number % WORD).cast("int"))
    return panel.groupBy(*keys, F.floor(number / WORD).alias("word")).agg(F.bit_or(bit).alias("bits"))


def period_gaps(panel: DataFrame, pack: ReportPack) -> DataFrame:
    """entity, periods, all_periods, missing of entities with fewer periods than the whole panel.

    One exchange over (entity, word), whose rows are small and hold up to 64 periods each; the
    second, by entity, moves only those. `missing` lists the absent periods in order. A null
    period counts as one and has no name in the list. Panels of one period have no gaps.
    """
    e, p = pack.entity, pack.period
    own = period_bitmaps(panel, pack, e)
    # a panel has as many words as it has decades, whatever the number of rows
    every = own.groupBy("word").agg(F.bit_or("bits").alias("bits"))
    words = F.sort_array(F.collect_list(F.struct("word", "bits")))
    all_words = every.agg(words).scalar()
    per_entity = own.groupBy(e).agg(F.sum(count_of("word", "bits")).alias("periods"), words.alias("own_words"))
    listed = per_entity.withColumn("all_words", all_words)
    total = F.aggregate("all_words", F.lit(0).cast("long"), lambda n, w: n + count_of(w["word"], w["bits"]))
    gaps = listed.withColumn("all_periods", total).filter(
        (F.col("all_periods") >= 2) & (F.col("periods") < F.col("all_periods"))
    )
    found = F.map_from_entries("own_words")

    def absent(w: Column) -> Column:
        seen = F.coalesce(F.try_element_at(found, w["word"]), F.lit(0).cast("long"))
        left = w["bits"].bitwiseAND(F.bitwise_not(seen))
        places = F.filter(F.sequence(F.lit(0), F.lit(WORD - 1)), lambda i: F.getbit(left, i) == 1)
        return F.transform(places, lambda i: F.lpad((w["word"] * WORD + i).cast("string"), 6, "0"))

    named = F.filter("all_words", lambda w: w["word"].isNotNull())
    own_named = F.filter("own_words", lambda w: w["word"].isNotNull())
    gaps = gaps.withColumn("own_words", own_named)
    missing = F.flatten(F.transform(named, absent))
    return gaps.select(
        e, "periods", "all_periods",
        F.transform(missing, lambda m: F.concat(F.left(m, F.lit(4)), F.lit("-"), F.right(m, F.lit(2)))).alias("missing"),
    )


def count_of(word: str | Column, bits: str | Column) -> Column:
    """Periods in a bitmap word; that of rows without a period counts as one."""
    word, bits = (F.col(x) if isinstance(x, str) else x for x in (word, bits))
    return F.when(word.isNull(), F.lit(1)).otherwise(F.bit_count(bits)).cast("long")


def suppressed(panel: Panel, columns) -> Column:
    """Rows imputed in any column, and the row after each of them."""
    flags = [F.coalesce(F.col(c), F.lit(False)) for c in columns if c.endswith(FLAG)]
    if not flags:
        return F.lit(False)
    imputed = reduce(lambda a, b: a | b, flags)
    return imputed | F.coalesce(F.lag(imputed).over(panel.history), F.lit(False))


def with_violations(series: DataFrame, pack: ReportPack, panel: Panel | None = None) -> DataFrame:
    """Add one boolean `__bad_<code>` per integrity rule.

    A rule the series cannot evaluate is logged and left out, never passed.
    """
    p = panel or pack.panel
    series = series.withColumn("__exempt", suppressed(p, series.columns))
    rules = {
        f"__bad_{r.code}": F.coalesce(r.holds(p) & ~F.col("__exempt"), F.lit(False))
        for r in pack.found_at(Stage.WINDOW)
    }
    try:
        return series.withColumns(rules)
    except AnalysisException:
        return series.withColumns(usable(series, rules))


def usable(frame: DataFrame, named: dict[str, Column]) -> dict[str, Column]:
    """The expressions that resolve against the frame; the others are logged."""
    kept = {}
    for name, expression in named.items():
        try:
            frame.select(expression)
        except AnalysisException as error:
            log.warning("rule %s cannot be evaluated: %s", name, error)
            continue
        kept[name] = expression
    return kept


def violation_columns(frame: DataFrame) -> list[str]:
    return [c for c in frame.columns if c.startswith("__bad_")]


def violation_counts(checked: DataFrame) -> DataFrame:
    """(code, affected_rows) of every rule, from one aggregate over the series."""
    names = violation_columns(checked)
    counts = checked.agg(*[F.count_if(F.col(c)).alias(c) for c in names])
    long = counts.unpivot([], names, "rule", "affected_rows")
    return long.select(F.expr("substring(rule, 7)").alias("code"), "affected_rows")


def sample_text(pack: ReportPack, names) -> Column:
    """Cells joined by " / ", numbers with two decimals."""
    texts = set(pack.schema.names) - set(pack.measures)
    parts = [sample_sql(n, is_number=n not in texts) for n in names]
    return F.expr(f"concat_ws(' / ', {', '.join(parts)})")


def sample_lists(
    frame: DataFrame, rules: dict[str, tuple[Column, Column]], pack: ReportPack, *others: DataFrame, n: int = 5
) -> DataFrame:
    """rule, samples: the first n offending rows of every rule in (entity, period) order, as texts.

    rules: name -> (condition, text). others: more rows (rule, entity, period, sample). All lists
    come from one pass: rows are exploded to the rules they offend, and the ranking's limit runs
    in each task before the exchange, so n rows per rule and task travel.
    """
    parts = list(others)
    if rules:
        hits = [F.when(c, F.struct(F.lit(name).alias("rule"), t.alias("sample"))) for name, (c, t) in rules.items()]
        place = F.col(pack.entity).alias("entity"), F.col(pack.period).alias("period")
        exploded = frame.select(*place, F.explode(F.array_compact(F.array(*hits))).alias("hit"))
        parts.insert(0, exploded.select("hit.rule", "entity", "period", "hit.sample"))
    rows = reduce(lambda a, b: a.unionByName(b), parts)
    first = W.partitionBy("rule").orderBy("entity", "period")
    ranked = rows.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= n)
    listed = F.sort_array(F.collect_list(F.struct("rank", "sample")))
    return ranked.groupBy("rule").agg(F.transform(listed, lambda r: r["sample"]).alias("samples"))


def ordered_issues(issues: DataFrame) -> DataFrame:
    return issues.orderBy(severity_rank(F.col("severity")), "step")


def placed_issues(issues: DataFrame) -> DataFrame:
    """issues with their 0-based `position`: by severity, then in the order found."""
    order = W.orderBy(severity_rank(F.col("severity")), "step")
    return issues.withColumn("position", F.row_number().over(order) - 1)


def health(issues: DataFrame, raw_rows: Column) -> DataFrame:
    """One row with the 0-100 health score; resolved issues weigh less.

    `raw_rows` is a literal or an aggregate over the issues.
    """
    resolved = F.col("action").isin(*RESOLVED_ACTIONS)
    factor = F.when(resolved, RESOLVED_FACTOR).otherwise(1.0)
    penalty = F.coalesce(F.sum(severity_weight(F.col("severity")) * factor), F.lit(0.0))
    # the sum of tenths is rounded first, so that 0.4 shares cannot fake a tie
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.bround(100 - F.round(penalty, 6), 0)))
    return issues.agg(
        F.when(raw_rows == 0, 0).otherwise(score).cast("int").alias("health_score"),
        F.count(F.lit(1)).alias("issue_count"),
    )
