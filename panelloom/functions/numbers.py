"""Number spellings of mixed-locale exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from panelloom.functions.text import without_blanks

# Accepted spellings, most specific first. A separator followed by
# exactly three digits is a thousands separator, so "12.500" is 12500.
#   pattern | characters to drop | character to turn into the decimal point
SPELLINGS = (
    (r"^-?\d{1,3}(\.\d{3})+,\d+$", ".", ","),  # 1.234,56
    (r"^-?\d{1,3}(,\d{3})+\.\d+$", ",", None),  # 1,234.56
    (r"^-?\d{1,3}(\.\d{3})+$", ".", None),  # 12.500
    (r"^-?\d{1,3}(,\d{3})+$", ",", None),  # 12,500
    (r"^-?\d+,\d+$", None, ","),  # 12,5
    (r"^-?\d+(\.\d+)?$", None, None),  # 12500, 12.5
)

# Fixed value: the common spellings no separator rule applies to, tried first.
UNAMBIGUOUS = r"^-?\d+(\.(\d{1,2}|\d{4,}))?$"


def plain_number(compact: Column) -> Column:
    """Rewrite any accepted spelling as digits with a point; null otherwise.

    `compact` is a text without blanks. It is read many times here, so it should
    be a column of an earlier projection, not an expression.
    """
    result = F.lit(None).cast("string")
    for pattern, drop, point in reversed(SPELLINGS):
        rewritten = compact
        if drop or point:
            # one translate: the decimal mark becomes a point, the group mark vanishes
            rewritten = F.translate(compact, (point or "") + (drop or ""), "." if point else "")
        result = F.when(compact.rlike(pattern), rewritten).otherwise(result)
    return F.when(compact.rlike(UNAMBIGUOUS), compact).otherwise(result)


def read_numbers(rows: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Turn text columns into numbers; `kinds` maps a column to its Spark type.

    The blank-free text is a projection of its own, worked out once per cell.
    """
    rows = rows.withColumns({n: without_blanks(F.col(n)) for n in kinds})
    read = {}
    for name, kind in kinds.items():
        value = plain_number(F.col(name)).try_cast("double")
        read[name] = value if kind == "double" else value.try_cast(kind)
    return rows.withColumns(read)
