"""Clean panel -> the full analysis: summaries, risks, deltas, headline."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from panelloom.operators import deltas, risks, summaries
from panelloom.operators.series import build_series, public_columns
from panelloom.pack import ReportPack
from panelloom.plans.ingest import IngestOutcome
from panelloom.sources.storage import store


@dataclass(frozen=True)
class AnalysisResult:
    """The result tables, lazy over one stored series and one stored entity summary."""

    pack: ReportPack
    series: DataFrame
    periods: DataFrame
    entity_count: DataFrame
    headline: DataFrame
    period_rows: DataFrame
    entity_rows: DataFrame
    dimension_rows: DataFrame
    risks: DataFrame
    deltas: DataFrame

    @property
    def series_rows(self) -> DataFrame:
        return public_columns(self.series)


def analyze(panel: DataFrame, pack: ReportPack, keep: bool = True) -> AnalysisResult:
    """Analyse a clean panel with one row per (entity, period)."""
    series = build_series(panel, pack)
    return analyze_series(store(series, "series") if keep else series, pack, keep)


def analyze_ingested(outcome: IngestOutcome) -> AnalysisResult:
    """Analyse an ingested panel; its stored series is used as it is."""
    return analyze_series(outcome.series, outcome.pack)


def analyze_series(series: DataFrame, pack: ReportPack, keep: bool = True) -> AnalysisResult:
    entities = summaries.entity_summary(series, pack)
    if keep:
        entities = store(entities, "entities")
    period_rows = summaries.period_summary(series, pack)
    onsets = risks.risk_onsets(entities, pack)
    return AnalysisResult(
        pack=pack,
        series=series,
        periods=summaries.periods(series, pack),
        entity_count=summaries.entity_count(series, pack),
        headline=summaries.headline(series, pack),
        period_rows=period_rows,
        entity_rows=entities,
        dimension_rows=summaries.dimension_summary(series, pack),
        risks=risks.risk_table(entities, pack),
        deltas=deltas.period_deltas(period_rows, series, onsets, pack),
    )
