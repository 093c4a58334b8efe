"""Value vocabularies and output record types shared by every stage."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

# Severity -> (rank, health-score weight).
SEVERITIES = {
    "kritik": (0, 25.0),
    "yuksek": (1, 12.0),
    "orta": (2, 6.0),
    "dusuk": (3, 3.0),
    "bilgi": (4, 1.0),
}

# What the pipeline did about an issue; the first three count as resolved.
ACTIONS = ("onarildi", "turetildi", "silindi", "karantina", "isaretlendi")
RESOLVED_ACTIONS = ACTIONS[:3]
RESOLVED_FACTOR = 0.4

# Metric units.
UNITS = ("TL", "adet", "%", "ay", "oran", "sayi")

TEXT, INTEGER, DECIMAL, PERIOD = "text", "integer", "decimal", "period"

PERIOD_PATTERN = r"^\d{4}-\d{2}$"

METRIC_VALUE = T.StructType(
    [
        T.StructField("metric", T.StringType()),
        T.StructField("label", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("unit", T.StringType()),
        T.StructField("entity", T.StringType()),
        T.StructField("period", T.StringType()),
    ]
)

ISSUE = T.StructType(
    [
        T.StructField("step", T.IntegerType()),
        T.StructField("code", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("action", T.StringType()),
        T.StructField("affected_rows", T.LongType()),
        T.StructField("detail", T.StringType()),
        T.StructField("samples", T.ArrayType(T.StringType())),
    ]
)


def severity_rank(severity: Column) -> Column:
    ranks = F.create_map(*[F.lit(x) for s, (rank, _) in SEVERITIES.items() for x in (s, rank)])
    return ranks[severity]


def severity_weight(severity: Column) -> Column:
    weights = F.create_map(*[F.lit(x) for s, (_, w) in SEVERITIES.items() for x in (s, w)])
    return weights[severity]


class PanelError(Exception):
    """Base of the data errors a caller is expected to handle."""

    code = "panel_error"

    def __init__(self, message: str, **details):
        super().__init__(message)
        self.details = details


class EmptyDatasetError(PanelError):
    code = "empty_dataset"


class SchemaMismatchError(PanelError):
    code = "schema_mismatch"


class IngestionError(PanelError):
    code = "ingestion_failed"


class UnknownPackError(PanelError):
    code = "unknown_pack"
