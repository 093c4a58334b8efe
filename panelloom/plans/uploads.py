"""Late records: a new upload joins what earlier uploads of the same report have left.

What is kept of an upload are its distinct rows, each with its first position (upload, place
in the upload) and its number of copies. Two such tables merge by a grouping that combines
map-side, so the order and the number of uploads do not matter: "the later record of an
(entity, period) wins" is decided over all of them. Only entities that the new upload names
are imputed and analysed again; the rows of all others stay as they are stored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from panelloom.operators import dedup, quality
from panelloom.operators.impute import impute
from panelloom.operators.series import build_series
from panelloom.pack import ReportPack
from panelloom.sources.storage import store

POSITION = "__position"


@dataclass(frozen=True)
class Holdings:
    """rows: the distinct rows of all uploads. series: the analysed clean panel."""

    rows: DataFrame
    series: DataFrame


def upload_rows(typed: DataFrame, seq: str, upload: int) -> DataFrame:
    """The distinct typed rows of one upload; uploads are numbered in the order they came."""
    place = F.struct(F.lit(upload).alias("upload"), F.col(seq).alias("seq"))
    return dedup.drop_exact_copies(typed.withColumn(POSITION, place).drop(seq), POSITION)


def merged_rows(held: DataFrame, fresh: DataFrame) -> DataFrame:
    """Distinct rows of both, with the first position and all copies."""
    data = [c for c in fresh.columns if c not in (POSITION, dedup.COPIES)]
    both = held.select(*fresh.columns).unionByName(fresh)
    return both.groupBy(*data).agg(F.min(POSITION).alias(POSITION), F.sum(dedup.COPIES).alias(dedup.COPIES))


def series_of(rows: DataFrame, pack: ReportPack) -> DataFrame:
    """The clean panel of distinct rows, imputed and with its metrics."""
    panel = impute(dedup.keep_last_record(rows, pack, POSITION), pack)
    clean, _ = quality.quarantine(panel, pack)
    return build_series(clean, pack)


def first_upload(fresh: DataFrame, pack: ReportPack) -> Holdings:
    rows = store(fresh, "upload_rows")
    return Holdings(rows, store(series_of(rows, pack), "series"))


def add_upload(held: Holdings, fresh: DataFrame, pack: ReportPack) -> Holdings:
    """Holdings after one more upload; earlier tables are left as they are.

    Stored rows and series of untouched entities are read once and copied, never shuffled by
    a window; the touched ones are told by a semi-join on the entities of the new upload.
    """
    fresh = store(fresh, "upload_rows")
    named = fresh.select(F.col(pack.entity).alias("__touched")).distinct()
    same = F.col(pack.entity).eqNullSafe(F.col("__touched"))
    again = store(merged_rows(held.rows.join(named, same, "left_semi"), fresh), "touched_rows")
    rows = held.rows.join(named, same, "left_anti").unionByName(again.select(*held.rows.columns))
    series = held.series.join(named, same, "left_anti").unionByName(
        series_of(again, pack).select(*held.series.columns)
    )
    return Holdings(store(rows, "rows"), store(series, "series"))
