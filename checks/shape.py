"""Same rounding on both sides of a comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

# Added before rounding: exact decimal ties would otherwise fall on either side,
# depending on summation order and on the engine's rounding of ties.
NUDGE = "1.2345678e-6"


def steady_round(x: Column, decimals: int) -> Column:
    return F.round(x + float(NUDGE), decimals)


def tidy(frame: DataFrame, decimals: int = 4) -> DataFrame:
    """Round doubles and drop the sign of zero, so summation order cannot show."""
    exprs = []
    for f in frame.schema.fields:
        if isinstance(f.dataType, T.DoubleType):
            exprs.append(f"round(`{f.name}` + {NUDGE}D, {decimals}) + 0D AS `{f.name}`")
        elif isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            exprs.append(f"bigint(`{f.name}`) AS `{f.name}`")
        else:
            exprs.append(f"`{f.name}`")
    return frame.selectExpr(*exprs)


def rounded(names: str, decimals: int = 4) -> str:
    """DuckDB select list of the same columns."""
    return ", ".join(
        f"round(CAST({n} AS DOUBLE) + {NUDGE}, {decimals}) + 0.0 AS {n}" for n in names.split()
    )


def whole(names: str) -> str:
    return ", ".join(f"CAST({n} AS BIGINT) AS {n}" for n in names.split())


def split_infinite(names: list[str], frame: DataFrame) -> DataFrame:
    """Keep finite values as numbers and name the others in `<name>_kind`."""
    exprs = [f"`{c}`" for c in frame.columns if c not in names]
    for n in names:
        odd = f"(isnan({n}) OR abs({n}) = double('inf'))"
        exprs.append(f"CASE WHEN {odd} THEN NULL ELSE {n} END AS {n}")
        exprs.append(
            f"CASE WHEN {n} IS NULL THEN 'none' WHEN isnan({n}) THEN 'nan' "
            f"WHEN {n} = double('inf') THEN 'inf' WHEN {n} = double('-inf') THEN '-inf' "
            f"ELSE 'finite' END AS {n}_kind"
        )
    return frame.selectExpr(*exprs)


def split_infinite_sql(names: str) -> str:
    parts = []
    for n in names.split():
        parts.append(
            f"CASE WHEN isfinite({n}) THEN round({n} + {NUDGE}, 4) + 0.0 END AS {n}, "
            f"CASE WHEN {n} IS NULL THEN 'none' WHEN isnan({n}) THEN 'nan' "
            f"WHEN {n} = CAST('inf' AS DOUBLE) THEN 'inf' "
            f"WHEN {n} = CAST('-inf' AS DOUBLE) THEN '-inf' ELSE 'finite' END AS {n}_kind"
        )
    return ", ".join(parts)
