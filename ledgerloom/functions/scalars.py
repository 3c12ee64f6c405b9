"""Column functions: identifiers, numbers, dates, header text and tolerances.

Everything here is a built-in expression, so it stays inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.params import MONEY

# Characters stripped from both ends of a text.
WHITESPACE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u2028\u2029"

# Line separators that stack several values in one cell.
LINE_BREAK = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"

# Cell texts that mean "nothing here" (the last two are hyphen and en dash).
NULL_TOKENS = ("", "None", "-", "\u2013")


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def blank_to_null(c: Column) -> Column:
    """Trim; an empty text becomes null."""
    return F.nullif(strip(c), F.lit(""))


def truthy(c: Column) -> Column:
    """Null for an empty text, so that ``coalesce`` skips it."""
    return F.nullif(c, F.lit(""))


def digits_only(c: Column) -> Column:
    return F.nullif(F.regexp_replace(c, "[^0-9]", ""), F.lit(""))


def registration_key(abn: Column, acn: Column) -> Column:
    """Digits of the ABN, or of the ACN when the ABN is null or empty."""
    return digits_only(F.coalesce(truthy(abn), acn))


def email_domain(c: Column) -> Column:
    """Lower-case text after the first ``@``."""
    return F.when(F.contains(c, F.lit("@")), F.lower(F.regexp_extract(c, "(?s)^[^@]*@(.*)$", 1)))


def name_key(c: Column) -> Column:
    return F.nullif(F.lower(strip(c)), F.lit(""))


def alias_list(c: Column) -> Column:
    """``|``-separated aliases, trimmed, blanks dropped."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), r"\|"), strip)
    return F.filter(parts, lambda p: p != "")


def order_key(c: Column) -> Column:
    """Purchase-order lookup key."""
    return F.upper(blank_to_null(c))


def spread_nulls(key: Column, row: Column) -> Column:
    """A left-join key whose nulls are spread over tasks by ``row``; the stand-ins (a NUL and a number) equal no real key."""
    return F.coalesce(key, F.concat(F.lit("\u0000"), F.pmod(F.xxhash64(row), F.lit(4096)).cast("string")))


def to_number(c: Column) -> Column:
    """Drop every character but digits, dot and minus, then parse; null when that fails."""
    return F.regexp_replace(c, r"[^0-9.\-]", "").try_cast("double")


def to_money(c: Column) -> Column:
    return F.regexp_replace(c, r"[^0-9.\-]", "").try_cast(MONEY)


def parse_date(c: Column) -> Column:
    """ISO, day/month/year, day-month-year or year/month/day; anything else is null.

    The pattern guard picks one format first, so no failed parse is paid per row.
    """
    t = strip(c)
    shapes = (
        (r"^\d{4}-\d{1,2}-\d{1,2}$", "y-M-d"),
        (r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/y"),
        (r"^\d{1,2}-\d{1,2}-\d{4}$", "d-M-y"),
        (r"^\d{4}/\d{1,2}/\d{1,2}$", "y/M/d"),
    )
    return F.coalesce(*[F.when(t.rlike(p), F.try_to_date(t, f)) for p, f in shapes])


def header_key(c: Column) -> Column:
    """Lower-case header with runs of space, underscore, hyphen and dot as one space."""
    return strip(F.lower(F.regexp_replace(c, r"[\s_\-.]+", " ")))


def header_parts(c: Column) -> Column:
    """The whole header key plus the key of each part of a composite header."""
    parts = F.filter(F.transform(F.split(c, "[/,&+]"), strip), lambda p: p != "")
    return F.array_union(F.array(header_key(c)), F.transform(parts, header_key))


def header_matches(c: Column, keys: tuple[str, ...]) -> Column:
    return F.coalesce(F.arrays_overlap(header_parts(c), F.array(*[F.lit(k) for k in keys])), F.lit(False))


def clean_cell(c: Column) -> Column:
    """Trimmed cell text, null for the tokens that mean "empty"."""
    t = strip(c)
    return F.when(~t.isin(*NULL_TOKENS), t)


def clean_response(c: Column) -> Column:
    """JSON object text out of a fenced or chatty response, trailing commas dropped."""
    text, fence = strip(c), F.lit("```")
    # the patterns are tried only where they can match: they read the whole text
    opened = F.when(F.startswith(text, fence), F.regexp_replace(text, r"(?i)^```(?:json)?\s*", "")).otherwise(text)
    body = strip(F.when(F.endswith(opened, fence), F.regexp_replace(opened, r"\s*```$", "")).otherwise(opened))
    obj = F.nullif(F.regexp_extract(body, r"(?s)(\{.*\})", 1), F.lit(""))
    return F.regexp_replace(obj, r",\s*([}\]])", "$1")


def round2(c: Column) -> Column:
    """Half-even to cents on decimals; null where the amount is out of range."""
    return F.bround(c, 2).try_cast(MONEY)


def fmt2(c: Column) -> Column:
    """A decimal with exactly two fraction digits."""
    return F.round(c, 2).try_cast("decimal(22,2)").cast("string")


def plain_number(c: Column) -> Column:
    """A decimal as text with trailing zeros removed but one fraction digit kept (``100.0``)."""
    return F.regexp_replace(c.cast(MONEY).cast("string"), "0{1,3}$", "")


def within(a: Column, b: Column, tolerance: str) -> Column:
    """Three-valued: null when ``a`` is null."""
    return F.abs(a - b) <= F.lit(tolerance).cast("decimal(10,6)")


def within_pct(a: Column, b: Column, pct: str) -> Column:
    """|a-b|/b within ``pct``; a zero reference needs equality; any negative reference passes."""
    limit = F.lit(pct).cast("decimal(10,6)")
    return F.when(a.isNull(), None).when(b == 0, a == 0).when(b < 0, F.lit(True)).otherwise(
        F.abs(a - b) <= limit * b
    )


def nested_field(path: str) -> Column:
    """``supplier.name`` style access; a missing parent gives null."""
    return F.col(path)
