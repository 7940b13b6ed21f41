"""Reading numbers out of cells and texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tariffloom import fixed
from tariffloom.functions.text import squeeze

PLAIN_NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def parse_plain(text: Column) -> Column:
    """Text as DOUBLE, null unless it is a plain decimal number."""
    return F.when(text.rlike(PLAIN_NUMBER), F.btrim(text).try_cast("double"))


def looks_numeric(text: Column) -> Column:
    """Numeric once separators and percent signs are gone."""
    return F.coalesce(F.regexp_replace(text, "[,%]", "").rlike(PLAIN_NUMBER), F.lit(False))


def checked_number(text: Column, number: Column) -> Column:
    """Number used in checks: numeric cells as they are, texts cut to whole numbers."""
    parsed = parse_plain(F.regexp_replace(text, ",", ""))
    cut = F.when(parsed >= 0, F.floor(parsed)).otherwise(F.ceil(parsed)).cast("double")
    return F.coalesce(number, cut)


def constant_number(text: Column, number: Column) -> Column:
    """Number of an extracted constant: ``,`` and ``%`` ignored, fractions kept."""
    return F.coalesce(number, parse_plain(F.regexp_replace(squeeze(text), "[,%]", "")))


def amount_of(text: Column, number: Column, mode: str = "strict") -> Column:
    """Whole amount for comparing with a notice.

    ``digits`` joins every digit of a text (signs and points vanish); ``strict`` accepts
    only a plain number with separators.
    """
    if mode == "digits":
        read = F.regexp_replace(text, "[^0-9]", "").try_cast("bigint")
    else:
        read = F.bround(parse_plain(F.regexp_replace(text, "[,원]", "")), 0).cast("bigint")
    return F.coalesce(F.bround(number, 0).cast("bigint"), read)


def clamp_price(edited: Column, original: Column, top: int = fixed.PRICE_MAX) -> Column:
    """Edited price, falling back to the original, kept inside 0..top."""
    value = F.coalesce(edited, original, F.lit(0))
    return F.least(F.greatest(value, F.lit(0)), F.lit(top))


def field_value(kind: Column, text: Column) -> Column:
    """Value of an input field as STRING by kind: int, percent (stored as share), year, text."""
    number = parse_plain(F.regexp_replace(text, "[^0-9.-]", ""))
    share = F.when(kind == "percent", number / 100).otherwise(number)
    whole = F.when(share == F.floor(share), share.try_cast("bigint"))
    as_text = F.coalesce(whole.cast("string"), share.cast("string"))
    return F.when(kind == "text", F.nullif(F.btrim(text), F.lit(""))).otherwise(as_text)


def field_valid(kind: Column, text: Column) -> Column:
    """Empty fields and texts are valid, numbers must parse and not be negative."""
    number = parse_plain(F.regexp_replace(text, "[^0-9.-]", ""))
    return (
        F.when(F.coalesce(F.btrim(text), F.lit("")) == "", True)
        .when(kind == "text", True)
        .otherwise(F.coalesce(number >= 0, F.lit(False)))
    )


def money_tokens(text: Column) -> Column:
    """All won amounts of a text in order."""
    return F.transform(
        F.regexp_extract_all(text, F.lit(fixed.MONEY), 1),
        lambda t: F.regexp_replace(t, ",", "").try_cast("bigint"),
    )


def segment_number(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, fixed.SEGMENT, 1), F.lit("")).try_cast("int")


def grade_number(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, fixed.GRADE, 1), F.lit("")).try_cast("int")


def floor_100(value: Column) -> Column:
    """Cut to hundreds, forgiving tiny float error from below."""
    return (F.floor(value / 100 + 1e-9) * 100).cast("bigint")


def growth_percent(before: Column, after: Column) -> Column:
    """Change in percent with two decimals; null without a non-zero earlier value."""
    return F.round((after - before) / F.nullif(before, F.lit(0)) * 100, 2)


def business_year(day: Column) -> Column:
    """December already belongs to the next business year."""
    return F.year(day) + (F.month(day) == 12).cast("int")
