"""Period, entity and dimension summaries and the headline figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelloom.pack import ReportPack, Stage


def period_totals(series: DataFrame, pack: ReportPack) -> DataFrame:
    """One row per period with the pack's period aggregates."""
    return series.groupBy(pack.period).agg(*pack.columns_at(Stage.PERIOD))


def period_summary(series: DataFrame, pack: ReportPack) -> DataFrame:
    """Period totals plus the change of each one against the previous period.

    The window has no partition key on purpose: its input is already one row per
    period, and YYYY-MM periods are few however large the series is.
    """
    totals = period_totals(series, pack)
    over_time = Window.orderBy(pack.period)
    deltas: dict[str, Column] = {}
    for a in pack.at(Stage.PERIOD):
        now = F.col(a.name)
        before = F.lag(now).over(over_time)
        deltas[f"{a.name}_delta"] = now - before
        deltas[f"{a.name}_delta_pct"] = F.when(before != 0, (now - before) / F.abs(before) * 100)
    return totals.withColumns(deltas)


def entity_summary(series: DataFrame, pack: ReportPack) -> DataFrame:
    """One row per entity: label, dimensions, span, trend statistics, pack aggregates.

    Reads the series of `build_series`. Straight after the entity windows it adds
    no exchange; over a stored series it combines map-side.
    """
    p = pack.panel
    period = F.col(pack.period)
    measures = [
        p.last(F.col(pack.label)).alias(pack.label),
        F.count(F.lit(1)).alias("periods_count"),
        F.min(period).alias("first_period"),
        F.max(period).alias("last_period"),
        *[p.last(F.col(d)).alias(d) for d in pack.dimensions],
    ]
    trend = pack.trend_column
    if trend:
        x = F.col(trend)
        measures += [
            p.first(x).alias("trend_first"),
            p.last(x).alias("trend_last"),
            F.avg(x).alias("trend_mean"),
            p.tail_mean(x, 3).alias("trend_last3"),
        ]
    measures += pack.columns_at(Stage.ENTITY)
    summary = series.groupBy(pack.entity).agg(*measures)
    return with_trend(summary) if trend else summary


def with_trend(summary: DataFrame) -> DataFrame:
    """Change per period and total change in percent of the trend column."""
    first, change = F.col("trend_first"), F.col("trend_last") - F.col("trend_first")
    steps = F.col("periods_count") - 1
    return summary.withColumns(
        {
            "trend_step": F.when(steps > 0, change / steps).otherwise(F.lit(0.0)),
            "trend_delta_pct": F.when(F.abs(first) > 1e-9, change / F.abs(first) * 100),
        }
    )


def dimension_summary(series: DataFrame, pack: ReportPack) -> DataFrame:
    """Long table (dimension, dimension_value, period, aggregates).

    One pass over the series: a grouping set per dimension instead of one scan
    each; rows are combined map-side before the exchange.
    """
    dims = pack.dimensions
    # A grouping set nulls the keys it leaves out, so the keys are copies.
    keys = {f"__dim_{d}": F.col(d) for d in dims}
    sets = [[F.col(k), F.col(pack.period)] for k in keys]
    grouped = (
        series.withColumns(keys)
        .groupingSets(sets, *[F.col(k) for k in keys], F.col(pack.period))
        .agg(
            *[F.grouping(F.col(k)).alias(f"{k}_out") for k in keys],
            *pack.columns_at(Stage.DIMENSION),
        )
    )
    name = F.coalesce(*[F.when(F.col(f"__dim_{d}_out") == 0, F.lit(d)) for d in dims])
    value = F.coalesce(*[F.col(k) for k in keys])
    return grouped.select(
        name.alias("dimension"),
        value.alias("dimension_value"),
        pack.period,
        *[a.name for a in pack.at(Stage.DIMENSION)],
    )


def headline(series: DataFrame, pack: ReportPack) -> DataFrame:
    """The headline aggregates of the last period as metric rows, nulls left out."""
    totals = period_totals(series, pack)
    names = list(pack.headline)
    last = totals.agg(
        F.max(pack.period).alias("period"),
        *[F.max_by(F.col(n).cast("double"), F.col(pack.period)).alias(n) for n in names],
    )
    return (
        last.unpivot("period", names, "metric", "value")
        .filter(F.col("value").isNotNull())
        .select(
            "metric",
            pack_lookup(pack, names, 0).alias("label"),
            "value",
            pack_lookup(pack, names, 1).alias("unit"),
            F.lit(None).cast("string").alias("entity"),
            "period",
        )
    )


def pack_lookup(pack: ReportPack, names: list[str], part: int) -> Column:
    """Label (part 0) or unit (part 1) of the column `metric` names."""
    pairs = [F.lit(x) for n in names for x in (n, pack.describe(n)[part])]
    return F.create_map(*pairs)[F.col("metric")]


def entity_count(series: DataFrame, pack: ReportPack) -> DataFrame:
    return series.agg(F.count_distinct(pack.entity).alias("entity_count"))


def periods(series: DataFrame, pack: ReportPack) -> DataFrame:
    """Sorted distinct periods, each with its predecessor."""
    distinct = series.select(F.col(pack.period).alias("period")).distinct()
    return distinct.withColumn("previous_period", F.lag("period").over(Window.orderBy("period")))


