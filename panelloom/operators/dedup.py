"""Exact copies and conflicting records of one (entity, period)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from panelloom.pack import ReportPack

COPIES = "__copies"  # input rows behind a panel row
VARIANTS = "__variants"  # distinct rows among them


def drop_exact_copies(typed: DataFrame, seq: str) -> DataFrame:
    """Distinct rows with their first position and number of copies.

    Grouped by every data column, so a run of copies collapses map-side and a
    key with many different rows is still spread over the cluster.
    """
    data = [c for c in typed.columns if c != seq]
    return typed.groupBy(*data).agg(F.min(seq).alias(seq), F.count(F.lit(1)).alias(COPIES))


def keep_last_record(distinct: DataFrame, pack: ReportPack, seq: str) -> DataFrame:
    """One row per (entity, period): the one whose first copy came last.

    An aggregate, not a ranking window: each task sends one row per key, however
    many records a key has.
    """
    keys = [pack.entity, pack.period]
    rest = [c for c in distinct.columns if c not in (*keys, seq, COPIES)]
    latest = distinct.groupBy(*keys).agg(
        F.max_by(F.struct(*rest), F.col(seq)).alias("__row"),
        F.sum(COPIES).alias(COPIES),
        F.count(F.lit(1)).alias(VARIANTS),
    )
    return latest.select(*keys, "__row.*", COPIES, VARIANTS)


def deduplicate(typed: DataFrame, pack: ReportPack, seq: str) -> DataFrame:
    return keep_last_record(drop_exact_copies(typed, seq), pack, seq)
