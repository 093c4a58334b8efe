"""Text-encoding expressions: single-byte Turkish text and mojibake repair.

Mojibake here is UTF-8 text that was once read as CP1252 and saved again.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from panelloom.functions.text import quoted

# Correct Turkish letters, telltale pairs, and their lead letters.
TURKISH_SCORED = "çğıöşüÇĞİÖŞÜâîû"
MOJIBAKE_PAIRS = ("Ã¶", "Ã¼", "Ã§", "Ã‡", "Ã–", "Ãœ", "Ä±", "Ä°", "ÄŸ", "Äž", "ÅŸ", "Åž")
MOJIBAKE_LEADS = "ÃÄÅÎÏ"

# Bytes 0x80-0x9F that CP1252 gives a character of its own.
CP1252_BYTES = [b for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)]
CP1252_CHARS = "".join(bytes([b]).decode("cp1252") for b in CP1252_BYTES)
CONTROLS = "".join(chr(b) for b in CP1252_BYTES)

# Bytes CP1254 leaves undefined; such a file is ISO-8859-9 instead.
CP1254_UNDEFINED = "\x81\x8d\x8e\x8f\x90\x9d\x9e"
# The six letters in which ISO-8859-9 and CP1254 differ from Latin-1.
LATIN1_SIX, TURKISH_SIX = "ÐÝÞðýþ", "ĞİŞğış"


def by_lead(pairs: tuple[str, ...]) -> str:
    """A pattern of the pairs that tries each lead letter once."""
    leads = dict.fromkeys(p[0] for p in pairs)
    return "|".join(f"{lead}[{''.join(p[1] for p in pairs if p[0] == lead)}]" for lead in leads)


PAIRS_PATTERN = by_lead(MOJIBAKE_PAIRS)


def has_mojibake(x: str) -> str:
    return f"{x} RLIKE {quoted(PAIRS_PATTERN)}"


def has_legacy_mojibake(latin: str) -> str:
    """has_mojibake of turkish_from_latin1: the pairs as they look in text read as Latin-1."""
    back = str.maketrans(TURKISH_SIX + CP1252_CHARS, LATIN1_SIX + CONTROLS)
    return f"{latin} RLIKE {quoted(by_lead(tuple(p.translate(back) for p in MOJIBAKE_PAIRS)))}"


def turkish_score(x: str) -> str:
    """SQL: Turkish letters minus twice the telltale pairs minus the lead letters."""
    return (
        f"(regexp_count({x}, '[{TURKISH_SCORED}]') - 2 * regexp_count({x}, "
        f"{quoted(PAIRS_PATTERN)}) - regexp_count({x}, '[{MOJIBAKE_LEADS}]'))"
    )


def undo_cp1252(x: str) -> str:
    """SQL: encode as CP1252, decode as UTF-8; null where either step fails.

    CP1252 bytes are reached through Latin-1: the characters CP1252 has of its
    own are first moved to the code points of their bytes. Plain ASCII stays as it is.
    """
    # ASCII characters fall out of both ranges before the long list is asked
    outside = f"[\\u0080-\\u009F[\\u0100-\\x{{10FFFF}}&&[^{CP1252_CHARS}]]]"
    as_latin = f"translate({x}, {quoted(CP1252_CHARS)}, {quoted(CONTROLS)})"
    as_bytes = f"encode({as_latin}, 'ISO-8859-1')"
    return (
        f"CASE WHEN NOT {x} RLIKE '[^\\\\u0000-\\\\u007F]' THEN {x} WHEN {x} RLIKE {quoted(outside)} THEN NULL "
        f"ELSE try_validate_utf8(cast({as_bytes} AS string)) END"
    )


def repaired(x: str) -> str:
    """SQL: the repaired text where repair is safe and raises the score, else null.

    The array binds the round trip to a name, so it is worked out once.
    """
    better = f"{turkish_score('f')} > {turkish_score(x)}"
    return f"get(filter(array({undo_cp1252(x)}), f -> {better}), 0)"


def repair_mojibake(name: str) -> Column:
    """Column transform: repair each text on its own, leave the others as they are.

    The repair is only worked out for texts that carry a telltale pair.
    """
    x = f"`{name}`"
    return F.expr(f"CASE WHEN {has_mojibake(x)} THEN coalesce({repaired(x)}, {x}) ELSE {x} END")


def turkish_from_latin1(x: str, keep_controls: bool = False) -> str:
    """SQL: text read as Latin-1 turned into CP1254 (or ISO-8859-9) text."""
    if keep_controls:
        return f"translate({x}, '{LATIN1_SIX}', '{TURKISH_SIX}')"
    return (
        f"translate({x}, {quoted(LATIN1_SIX + CONTROLS)}, {quoted(TURKISH_SIX + CP1252_CHARS)})"
    )
