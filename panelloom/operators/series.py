"""The enriched series: one row per (entity, period) with every derived metric."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from panelloom.functions.panel import CHANGE, ROW, ROWS, SEEN_LABEL, SEEN_PERIOD, Panel
from panelloom.pack import ReportPack, Stage


def build_series(frame: DataFrame, pack: ReportPack, panel: Panel | None = None) -> DataFrame:
    """Add the pack's metrics and the row position to a clean panel.

    Pack order is dependency order within each stage. All windows partition by
    entity, so they share one exchange. `__` columns are internal: what later steps
    need from an entity's other rows is kept here, so that a stored series is never
    shuffled by entity again for it.
    """
    p = panel or pack.panel
    for metric in pack.at(Stage.ROW):
        frame = frame.withColumn(metric.name, metric.build(p))
    frame = frame.withColumns(
        {
            ROW: F.row_number().over(p.history) - 1,
            ROWS: F.count(F.lit(1)).over(p.whole),
        }
    )
    for metric in pack.at(Stage.WINDOW):
        frame = frame.withColumn(metric.name, metric.build(p))
    trend = F.col(pack.trend_column)
    return frame.withColumns(
        {
            SEEN_PERIOD: p.previous(F.col(pack.period)),
            SEEN_LABEL: p.previous(F.col(pack.label)),
            CHANGE: trend - p.previous(trend),
            **{h.name: h.build(p) for h in pack.at(Stage.HELPER)},
        }
    )


def public_columns(frame: DataFrame) -> DataFrame:
    """The result table a user sees: everything but the `__` helper columns."""
    return frame.select([c for c in frame.columns if not c.startswith("__")])
