"""Header mapping and type coercion of all-string rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from panelloom.functions.numbers import read_numbers
from panelloom.functions.text import blank_to_null
from panelloom.model import SchemaMismatchError
from panelloom.pack import ReportPack


def map_columns(rows: DataFrame, pack: ReportPack, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rename to the pack's columns and drop the rest; missing required ones raise."""
    match = pack.match_headers([c for c in rows.columns if c not in keep])
    if match.missing:
        raise SchemaMismatchError(
            f"required columns missing: {', '.join(match.missing)}",
            missing_columns=match.missing,
            found_columns=[c for c in rows.columns if c not in keep],
            expected_pack=pack.key,
        )
    named = [F.col("`" + h.replace("`", "``") + "`").alias(n) for h, n in match.columns.items()]
    return rows.select(*named, *keep)


def unknown_columns(headers, pack: ReportPack) -> list[str]:
    """Headers that give no column: unknown ones and repeated ones, in order."""
    unused = set(pack.match_headers(headers).unused)
    return [h for h in headers if h in unused]


def coerce(rows: DataFrame, pack: ReportPack) -> DataFrame:
    """Clean text, read numbers in any accepted spelling; unreadable becomes null."""
    present = [f for f in pack.schema if f.name in rows.columns]
    cleaned = rows.withColumns({f.name: blank_to_null(F.col(f.name)) for f in present})
    return read_numbers(cleaned, {f.name: f.dataType.simpleString() for f in present if f.name in pack.measures})


def missing_counts(pack: ReportPack, columns) -> dict[str, Column]:
    """Per measure, the number of cells that are blank or unreadable."""
    return {
        f"missing_{m}": F.count_if(F.col(m).isNull()) for m in pack.measures if m in columns
    }


def bad_period(pack: ReportPack) -> Column:
    """Present but not in the expected form."""
    period = F.col(pack.period)
    return F.coalesce(period.isNotNull() & ~period.rlike(pack.period_pattern), F.lit(False))


def drop_bad_periods(typed: DataFrame, pack: ReportPack, any_bad: bool | Column) -> DataFrame:
    """Remove rows with a malformed period.

    Rows without a period go with them only when the input has a malformed one;
    otherwise they stay and end in quarantine.
    """
    flag = F.lit(any_bad) if isinstance(any_bad, bool) else any_bad
    return typed.filter(~bad_period(pack) & (F.col(pack.period).isNotNull() | ~flag))


def has_bad_period(typed: DataFrame, pack: ReportPack) -> Column:
    """The input-wide flag as a scalar subquery."""
    return typed.agg(F.coalesce(F.bool_or(bad_period(pack)), F.lit(False))).scalar()
