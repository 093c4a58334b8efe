"""Text helpers: number formatting as in the report texts, and text templates."""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column, functions as F

# Turkish letters and their ASCII forms.
TURKISH_LETTERS = "çğıöşüÇĞİÖŞÜ"
ASCII_LETTERS = "cgiosuCGIOSU"


def fold_name(name: Column) -> Column:
    """Spelling-insensitive form of an entity or dimension name."""
    folded = F.lower(F.translate(name, TURKISH_LETTERS, ASCII_LETTERS))
    folded = F.replace(folded, F.lit("ß"), F.lit("ss"))
    folded = F.replace(folded, F.lit("ς"), F.lit("σ"))
    # plain ASCII, as most keys are, has none of these letters
    return strip(F.when(F.rlike(name, F.lit(r"[^\x00-\x7F]")), folded).otherwise(F.lower(name)))


# The characters with the Unicode White_Space property.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def strip(x: Column) -> Column:
    """Strip every Unicode blank at both ends; plain trim knows only the space."""
    return F.btrim(x, F.lit(WHITE_SPACE))


def without_blanks(x: Column) -> Column:
    return F.translate(x, WHITE_SPACE, "")


def blank_to_null(x: Column) -> Column:
    return F.nullif(strip(x), F.lit(""))


def quoted(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def fixed_sql(x: str, decimals: int, thousands: str = "") -> str:
    """SQL for half-even decimal text; `thousands` is the group separator.

    The texts are long, and one SQL string is far cheaper to build than a tree
    of Column calls.
    """
    shown = f"translate(format_number({x}, {decimals}), ',', '{thousands}')"
    return (
        f"CASE WHEN isnan({x}) THEN 'nan' WHEN {x} = double('inf') THEN 'inf' "
        f"WHEN {x} = double('-inf') THEN '-inf' ELSE {shown} END"
    )


def sample_sql(name: str, is_number: bool) -> str:
    """A cell as shown in the samples of a quality issue."""
    shown = fixed_sql(f"`{name}`", 2, " ") if is_number else f"string(`{name}`)"
    return f"coalesce({shown}, 'None')"


def number(name: str) -> Column:
    """A numeric column in an impact formula, where null counts as 0."""
    return F.expr(f"coalesce(double(`{name}`), 0D)")


def render(template: str) -> Column:
    """Turn "{column:.1f} ..." into one concat expression.

    Formats: `.Nf` decimals, `tl` money, `d` whole number, none = text as is.
    Null numbers show as 0.
    """
    parts = []
    for literal, name, spec, _ in Formatter().parse(template):
        if literal:
            parts.append(quoted(literal))
        if name is None:
            continue
        value = f"coalesce(double(`{name}`), 0D)"
        if spec == "tl":
            parts += [fixed_sql(value, 0, "."), "' TL'"]
        elif spec == "d":
            parts.append(f"string(bigint({value}))")
        elif spec:
            parts.append(fixed_sql(value, int(spec.strip(".f"))))
        else:
            parts.append(f"coalesce(string(`{name}`), 'None')")
    return F.expr(f"concat({', '.join(parts)})")
