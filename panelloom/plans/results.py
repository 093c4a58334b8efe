"""Result tables a user reads: overview, periods, entities, risks, quality, packs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from panelloom.operators import risks as risk_ops
from panelloom.operators.quality import placed_issues
from panelloom.operators.series import public_columns
from panelloom.pack import ReportPack, Stage
from panelloom.packs.registry import PACKS
from panelloom.plans.analyze import AnalysisResult
from panelloom.plans.ingest import IngestOutcome
from panelloom.sources import ledger as ledgers


def overview(result: AnalysisResult, top: int = 8) -> dict[str, DataFrame]:
    return {
        "periods": result.periods,
        "entity_count": result.entity_count,
        "headline_metrics": shown_metrics(result.headline),
        "period_rows": result.period_rows,
        "risk_counts_by_severity": risk_ops.severity_counts(result.risks),
        "top_risks": shown_risks(risk_ops.top_risks(result.risks, top)),
    }


def period_tables(result: AnalysisResult) -> dict[str, DataFrame]:
    return {
        "periods": result.periods,
        "rows": result.period_rows,
        "deltas": result.deltas,
        "dimension_rows": result.dimension_rows,
    }


def entity_tables(result: AnalysisResult, include_series: bool = True) -> dict[str, DataFrame]:
    tables = {
        "columns": entity_columns(result.series.sparkSession, result.pack),
        "rows": result.entity_rows,
    }
    if include_series:
        tables["series_rows"] = result.series_rows
    return tables


def entity_columns(spark: SparkSession, pack: ReportPack) -> DataFrame:
    """Name, label and unit of the entity table's columns; internal ones left out."""
    rows = [(pack.entity, "Kod", ""), (pack.label, "Ad", "")]
    for d in pack.dimensions:
        label, _ = pack.describe(d)
        rows.append((d, label if label != d else d.replace("_", " ").title(), ""))
    labels = pack.wording.labels[Stage.ENTITY]
    rows += [(a.name, *labels[a.name]) for a in pack.at(Stage.ENTITY) if a.name not in pack.hidden]
    numbered = [(i, *row) for i, row in enumerate(rows)]
    return spark.createDataFrame(numbered, "position int, name string, label string, unit string")


def shown_metrics(metrics: DataFrame) -> DataFrame:
    return metrics.withColumn("value", F.bround("value", 4))


def shown_risks(risks: DataFrame) -> DataFrame:
    """Risks with the rounding of the user-facing table."""
    rounded = "transform(evidence, e -> struct(e.metric, e.label, bround(e.value, 4) AS value, e.unit, e.entity, e.period))"  # noqa: E501
    return risks.withColumns(
        {
            "evidence": F.expr(rounded),
            "financial_impact_tl": F.bround("financial_impact_tl", 2),
        }
    )


def risk_tables(
    result: AnalysisResult, severity: str | None = None, period: str | None = None
) -> dict[str, DataFrame]:
    """Counts and totals always describe the filtered list."""
    chosen = risk_ops.filter_risks(result.risks, severity, period)
    return {
        "totals": risk_ops.risk_totals(chosen),
        "by_severity": risk_ops.severity_counts(chosen),
        "by_code": risk_ops.code_counts(chosen),
        "risks": shown_risks(risk_ops.ordered_risks(chosen)),
    }


def quality_table(outcome: IngestOutcome) -> DataFrame:
    """The issues with their place in the report; a few dozen rows."""
    return placed_issues(outcome.issues).drop("step")


def pack_catalogue(spark: SparkSession) -> DataFrame:
    rows = [
        (
            p.key, p.title, p.description, p.entity, p.period, list(p.dimensions),
            p.required, len(p.found_at(Stage.ENTITY)), len(p.at(Stage.ROW, Stage.WINDOW)), "",
        )
        for p in PACKS.values()
    ]
    return spark.createDataFrame(
        rows,
        "key string, title string, description string, entity_key string, period_key string, "
        "dimensions array<string>, required_columns array<string>, risk_rule_count int, "
        "metric_count int, sample_file string",
    )


def write_series(result: AnalysisResult, path: str) -> None:
    """Store the series partitioned by period.

    Ranges over (period, entity) split a large period over several tasks and
    give each task few periods, hence few files.
    """
    pack = result.pack
    rows = public_columns(result.series)
    rows.repartitionByRange(pack.period, pack.entity).write.partitionBy(pack.period).parquet(path)


def record_dataset(outcome: IngestOutcome, path: str, filename: str, ledger: str) -> str:
    """Append the ingested dataset to the ledger and return its id."""
    spark = outcome.series.sparkSession
    dataset_id = uuid.uuid4().hex[:16]
    digest = ledgers.content_digest(spark, path)
    record = outcome.report.select(
        F.lit(dataset_id).alias("dataset_id"),
        F.lit(filename).alias("filename"),
        F.lit(outcome.pack.key).alias("pack_key"),
        digest.select("content_hash").scalar().alias("content_hash"),
        F.lit(path).alias("stored_path"),
        "raw_row_count",
        "clean_row_count",
        "quarantined_row_count",
        "health_score",
        "encoding_detected",
        F.to_json(F.struct("*")).alias("quality_json"),
    )
    ledgers.append(record, ledger)
    return dataset_id
