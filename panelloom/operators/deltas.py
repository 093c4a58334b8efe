"""What changed from one period to the next: metrics, movers, new risks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelloom.functions.panel import CHANGE, SEEN_LABEL, SEEN_PERIOD
from panelloom.functions.text import quoted
from panelloom.model import METRIC_VALUE
from panelloom.operators.summaries import periods
from panelloom.pack import ReportPack, Stage


def metric_value(name: str, label: str, value: str, unit: str, entity: str, period: str) -> str:
    """SQL of one metric record; value, entity and period are SQL expressions."""
    return (
        f"named_struct('metric', '{name}', 'label', {quoted(label)}, 'value', double({value}), "
        f"'unit', {quoted(unit)}, 'entity', string({entity}), 'period', string({period}))"
    )


def changes(series: DataFrame, pack: ReportPack) -> DataFrame:
    """Change of the trend column per entity between consecutive global periods.

    The predecessor must be the global previous period and carry the same label;
    a label change or a missing month gives no row. The series already knows each
    row's predecessor, so neither a pivot nor a shuffle of the series is needed.
    """
    calendar = periods(series, pack).select(
        F.col("period").alias("__p"), F.col("previous_period").alias("__pp")
    )
    moved = series.select(
        F.col(pack.entity).alias("entity"),
        F.col(pack.label).alias("label"),
        F.col(pack.period).alias("period"),
        F.col(CHANGE).alias("change"),
        SEEN_PERIOD,
        SEEN_LABEL,
    ).filter(F.col("change").isNotNull() & F.col("label").eqNullSafe(F.col(SEEN_LABEL)))
    return (
        moved.join(
            calendar,
            (F.col("period") == F.col("__p")) & (F.col(SEEN_PERIOD) == F.col("__pp")),
        )
        .select("entity", "label", "period", F.col("__pp").alias("previous_period"), "change")
    )


def top_movers(series: DataFrame, pack: ReportPack, n: int = 3) -> DataFrame:
    """The n largest rises and the n largest falls of every period.

    The rank limit is pushed below the exchange, so each task ships at most n
    rows per period and direction.
    """
    moved = changes(series, pack).filter(F.col("change") != 0)
    direction = F.when(F.col("change") > 0, "up").otherwise("down")
    size = F.abs("change")
    rank = Window.partitionBy("period", "direction").orderBy(size.desc(), F.asc("entity"))
    return (
        moved.withColumn("direction", direction)
        .withColumn("rank", F.row_number().over(rank))
        .filter(F.col("rank") <= n)
    )


def new_risks(risks: DataFrame) -> DataFrame:
    """Sorted distinct rule codes by the period they were first seen in."""
    return (
        risks.filter(F.col("first_seen_period").isNotNull())
        .groupBy(F.col("first_seen_period").alias("period"))
        .agg(F.sort_array(F.collect_set("code")).alias("new_risks"))
    )


def period_deltas(
    summary: DataFrame, series: DataFrame, onsets: DataFrame, pack: ReportPack
) -> DataFrame:
    """One row per period: metrics, movers up and down, newly seen risk codes.

    `onsets` needs the code and first_seen_period of every finding.

    Every side has one row per period before the joins.
    """
    metrics = []
    for a in pack.at(Stage.PERIOD):
        label, unit = pack.describe(a.name)
        item = metric_value(a.name, label, f"`{a.name}`", unit, "NULL", "NULL")
        metrics.append(f"CASE WHEN `{a.name}` IS NOT NULL THEN {item} END")
    period = F.col(pack.period)
    base = summary.select(
        period.alias("period"),
        F.lag(period).over(Window.orderBy(period)).alias("previous_period"),
        F.expr(f"array_compact(array({', '.join(metrics)}))").alias("metrics"),
    )

    label, unit = pack.describe(pack.trend_column)
    name = f"{pack.trend_column}_change"
    item = metric_value(name, f"{label} değişimi", "change", unit, "entity", "period")
    listed = F.struct("rank", F.expr(item).alias("item"))

    def side(direction: str) -> Column:
        # at most n entries per period
        ranked = F.sort_array(F.collect_list(F.when(F.col("direction") == direction, listed)))
        return F.transform(ranked, lambda r: r["item"])

    movers = (
        top_movers(series, pack)
        .groupBy("period")
        .agg(side("up").alias("movers_up"), side("down").alias("movers_down"))
    )
    no_metrics = F.array().cast(f"array<{METRIC_VALUE.simpleString()}>")
    no_codes = F.array().cast("array<string>")
    return (
        base.join(movers, "period", "left")
        .join(new_risks(onsets), "period", "left")
        .select(
            "period",
            "previous_period",
            "metrics",
            F.coalesce("movers_up", no_metrics).alias("movers_up"),
            F.coalesce("movers_down", no_metrics).alias("movers_down"),
            F.coalesce("new_risks", no_codes).alias("new_risks"),
            no_codes.alias("resolved_risks"),  # always empty in this report
        )
    )


def snapshot_pair(series: DataFrame, pack: ReportPack, period: str) -> DataFrame:
    """The snapshot columns of a period and its predecessor, told apart by `scope`.

    The predecessor is found by a scalar subquery, so only two periods are read
    when the series is stored partitioned by period.
    """
    earlier = series.filter(F.col(pack.period) < period).agg(F.max(pack.period)).scalar()
    scope = F.when(F.col(pack.period) == period, "current").otherwise("previous")
    wanted = (F.col(pack.period) == period) | (F.col(pack.period) == earlier)
    return series.filter(wanted).select(
        scope.alias("scope"),
        F.col(pack.period).alias("period"),
        pack.entity,
        pack.label,
        *[c for c in pack.snapshot if c in series.columns],
    )
