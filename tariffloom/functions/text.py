"""Cleaning and shaping of cell texts as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tariffloom import fixed

# Printable ASCII and precomposed Hangul are their own NFKC form.
STABLE_TEXT = r"^[\x20-\x7E가-힣]*$"


def nfkc(text: Column) -> Column:
    """NFKC form by the normalizer that Spark's collations bring along, called inside the JVM.

    Spark takes a reflective call for one that could differ from run to run, so use it in a
    projection and not inside an aggregate, a lambda or a join condition.
    """
    folded = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(True))
    return F.when(~text.rlike(STABLE_TEXT), folded).otherwise(text)


def drop_invisible(text: Column) -> Column:
    """Remove the Unicode categories Cf (format) and Cc (control)."""
    return F.regexp_replace(text, r"[\p{Cf}\p{Cc}]", "")


def sanitize(text: Column) -> Column:
    """NFKC, then no invisible characters."""
    return drop_invisible(nfkc(text))


def removed_codepoints(raw: Column, clean: Column) -> Column:
    """The characters of ``raw`` missing from ``clean`` as ``U+XXXX``, distinct, in order."""
    gone = F.array_except(F.split(raw, ""), F.concat(F.split(clean, ""), F.array(F.lit(""))))
    return F.array_join(F.transform(gone, lambda c: F.format_string("U+%04X", F.ascii(c))), " ")


def squeeze(text: Column) -> Column:
    """Drop all whitespace, Unicode spaces included."""
    return F.regexp_replace(text, r"(?U)\s+", "")


def one_line(text: Column, limit: int = fixed.LABEL_MAX) -> Column:
    """Single-spaced text cut to ``limit`` characters with an ellipsis."""
    flat = F.btrim(F.regexp_replace(text, r"(?U)\s+", " "))
    return F.when(F.length(flat) <= limit, flat).otherwise(
        F.concat(F.substring(flat, 1, limit), F.lit("…"))
    )


def normalize_label(text: Column) -> Column:
    """Canonical label: unit notes, decoration and whitespace go, digits and words stay."""
    clean = sanitize(text)
    no_unit = F.regexp_replace(clean, "(?U)" + fixed.UNIT_NOTE, "")
    return squeeze(F.translate(no_unit, fixed.DECORATION, ""))


def key_form(text: Column) -> Column:
    """Comparison form of constant keys: no whitespace, no punctuation."""
    return F.regexp_replace(text, "(?U)" + fixed.KEY_PUNCTUATION, "")


def is_blank(text: Column) -> Column:
    """Null or only whitespace of any kind."""
    return text.isNull() | text.rlike(r"(?U)^\s*$")


def bigrams(text: Column) -> Column:
    """Two-character windows; shorter texts are their own token, empty ones have none."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    n = F.greatest(F.size(chars) - 1, F.lit(0))
    windows = F.zip_with(F.slice(chars, F.lit(1), n), F.slice(chars, F.lit(2), n), lambda a, b: F.concat(a, b))
    return F.when(F.size(chars) > 1, windows).otherwise(chars)


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def token_counts(tokens: Column) -> Column:
    """Distinct tokens with their count, as ``array<struct<token,tf>>`` inside the row, by token.

    Equal tokens are runs of the sorted array, so the work is that of sorting.
    """
    def runs(s: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.greatest(F.size(s) - 1, F.lit(0))), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        return F.when(F.size(s) > 0, _bound(starts, lambda b: F.transform(b, lambda i, k: F.struct(
            F.get(s, i).alias("token"), (F.coalesce(F.get(b, k + 1), F.size(s)) - i).alias("tf"))))).otherwise(
            F.array().cast("array<struct<token:string,tf:int>>"))

    return _bound(F.array_sort(tokens), runs)


def multiset(tokens: Column) -> Column:
    """A multiset as a set: the k-th equal token becomes ``token#k``."""
    return F.flatten(F.transform(token_counts(tokens), lambda c: F.transform(
        F.sequence(F.lit(1), c["tf"]), lambda k: F.concat(c["token"], F.lit("#"), k.cast("string")))))


def a1_name(row: Column, col: Column) -> Column:
    """Spreadsheet name of a 0-based cell, up to three column letters."""
    def letter(n: Column) -> Column:
        return F.chr(n.cast("bigint") + 65)

    first = F.when(col >= 702, letter(F.floor((col - 702) / 676) % 26)).otherwise("")
    second = F.when(col >= 26, letter(F.floor((col - 26) / 26) % 26)).otherwise("")
    return F.concat(first, second, letter(col % 26), (row + 1).cast("string"))


def money_text(amount: Column) -> Column:
    return F.concat(F.format_number(amount, 0), F.lit("원"))


def locator_text(chapter: Column, item: Column, table_no: Column, row: Column, label: Column) -> Column:
    """Where a notice amount stands, on one line; empty parts are left out."""
    spot = F.concat(F.lit("표"), table_no.cast("string"), F.lit(" 행"), row.cast("string"))
    short = one_line(label)
    return F.concat_ws(" › ", F.nullif(chapter, F.lit("")), F.nullif(item, F.lit("")), spot,
                       F.nullif(short, F.lit("")))


def grouped_number(value: Column) -> Column:
    """Whole numbers with thousands separators, four significant digits otherwise, ``-`` for
    null."""
    whole = value == F.floor(value)
    scale = F.pow(F.lit(10.0), F.floor(F.log10(F.abs(value))) - 3)
    short = F.round(value / scale) * scale
    text = F.regexp_replace(F.format_string("%,.6f", short), r"\.?0+$", "")
    return F.when(value.isNull(), "-").when(whole, F.format_number(value, 0)).otherwise(text)
