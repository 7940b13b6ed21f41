"""Reading meaning out of labels: structure, grade names, numbers, opposites, classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tariffloom import fixed
from tariffloom.functions.text import multiset, squeeze


def structure_key(norm: Column) -> Column:
    """One comparable key for labels of exact shape (band, ordinal, form), else null."""
    def part(pattern: str, n: int) -> Column:
        return F.regexp_extract(norm, pattern, n)

    band = F.concat_ws(":", F.lit("band"), part(fixed.BAND, 1).try_cast("double").cast("string"),
                       part(fixed.BAND, 2))
    ordinal = F.concat_ws(":", F.lit("ordinal"),
                          part(fixed.ORDINAL, 1).try_cast("decimal(38,0)").cast("string"),
                          part(fixed.ORDINAL, 2))
    form = F.concat_ws(":", F.lit("form"), part(fixed.FORM, 1), part(fixed.FORM, 2))
    return (
        F.when(norm.rlike(fixed.BAND), band)
        .when(norm.rlike(fixed.ORDINAL), ordinal)
        .when(norm.rlike(fixed.FORM), form)
    )


def same_structure(left: Column, right: Column) -> Column:
    """True or false when both labels have a structure, null otherwise."""
    a, b = structure_key(left), structure_key(right)
    return F.when(a.isNotNull() & b.isNotNull(), a == b)


def grade_name(name: Column) -> Column:
    """``struct<kind,base,letter,variant>`` of a grade name."""
    text = F.btrim(F.coalesce(name, F.lit("")))
    base = F.regexp_extract(text, fixed.GRADE_NAME, 1)
    letter = F.regexp_extract(text, fixed.GRADE_NAME, 2)
    extended = F.regexp_extract(text, fixed.GRADE_NAME, 3) != ""
    named = text.rlike(fixed.GRADE_NAME)
    tiered = letter.isin(*fixed.LETTERS)
    add_letter = F.regexp_extract(text, fixed.ADD_NAME, 2)
    kind = (
        F.when(text.isin(*fixed.SPECIAL_GRADES), "special")
        .when(named & ~tiered, "unknown")
        .when(named & base.rlike("^[0-9]등급$"), "ij")
        .when(named & base.rlike("^[0-9]+구간$"), "jh")
        .when(named & base.rlike("^특례[0-9]+$"), "sj")
        .when(named, "unknown")
        .when(text.rlike(fixed.ADD_NAME) & add_letter.isin(*fixed.LETTERS), "add")
        .otherwise("unknown")
    )
    graded = kind.isin("ij", "jh", "sj")
    return F.struct(
        kind.alias("kind"),
        F.when(graded, base).when(kind == "add", F.regexp_extract(text, fixed.ADD_NAME, 1))
        .otherwise(text).alias("base"),
        F.when(graded, letter).when(kind == "add", add_letter).otherwise("").alias("letter"),
        F.when(graded & extended, "확장형").otherwise("기본형").alias("variant"),
    )


def plain_numbers(norm: Column) -> Column:
    """The numbers of a label that tell items apart (years do not), as a ``token#k`` set."""
    found = F.regexp_extract_all(norm, F.lit(fixed.NUMBER_TOKEN), 1)
    return F.array_sort(multiset(F.filter(found, lambda t: ~t.rlike(fixed.YEAR_TOKEN))))


def numeric_relation(left: Column, right: Column) -> Column:
    """``same``, ``extra`` (one side only adds numbers) or ``conflict`` of two number sets."""
    return (
        F.when(left == right, "same")
        .when((F.size(F.array_except(left, right)) == 0) | (F.size(F.array_except(right, left)) == 0),
              "extra")
        .otherwise("conflict")
    )


def opposite_mask(norm: Column) -> Column:
    """Two bits per antonym group: which of its words the label contains."""
    mask = F.lit(0)
    for n, words in enumerate(fixed.ANTONYMS):
        for k, word in enumerate(words):
            mask = mask + F.contains(norm, F.lit(word)).cast("int") * (1 << (2 * n + k))
    return mask


def negated(norm: Column) -> Column:
    hit = F.lit(False)
    for marker in fixed.NEGATIONS:
        hit = hit | F.contains(norm, F.lit(marker))
    return hit


def opposite(left_mask: Column, right_mask: Column, left_neg: Column, right_neg: Column) -> Column:
    """Both labels name a group's words but not the same ones, or only one is negated."""
    clash = F.lit(False)
    for n in range(len(fixed.ANTONYMS)):
        a = F.shiftright(left_mask, 2 * n).bitwiseAND(3)
        b = F.shiftright(right_mask, 2 * n).bitwiseAND(3)
        clash = clash | ((a != 0) & (b != 0) & (a != b))
    return clash | (left_neg != right_neg)


def classify_by_phrases(text: Column, rules: list[tuple[tuple[str, ...], str]],
                        otherwise: str | None = None) -> Column:
    """Class of a text: the first rule whose phrases all occur."""
    chosen = None
    for phrases, name in rules:
        test = F.lit(True)
        for phrase in phrases:
            test = test & F.contains(text, F.lit(phrase))
        chosen = F.when(test, name) if chosen is None else chosen.when(test, name)
    return chosen.otherwise(otherwise) if chosen is not None else F.lit(otherwise)


def supplement_rules() -> list[tuple[tuple[str, ...], str]]:
    """Phrase rules of supplementary items: single phrases, then household by score."""
    rules = [((phrase,), name) for phrase, name in fixed.ADD_PHRASES]
    for household, names in fixed.ADD_HOUSEHOLDS:
        rules += [((household, tier), names[n]) for tier, n in fixed.ADD_TIERS]
        rules.append(((household,), names[1]))
    return rules


def supplement_item(label: Column) -> Column:
    return classify_by_phrases(squeeze(label), supplement_rules())
