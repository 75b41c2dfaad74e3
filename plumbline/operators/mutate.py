"""Answers with one planted defect, as expressions; fixed values of the defects stand with the samples."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_number(text: Column) -> Column:
    return F.regexp_extract(text, r"\d+", 0)


def number_raised(text: Column) -> Column:
    """The first number is larger by one, however long it is; texts without a number stay as they are."""
    digits = first_number(text)
    # trailing nines turn to zeros, and the digit before them goes up
    nines = F.length(F.regexp_extract(digits, "9*$", 0))
    head = F.substring(digits, F.lit(1), F.length(digits) - nines)
    bare = F.regexp_replace(head, "^0+(?=.)", "")
    last = F.substring(head, F.length(head), F.lit(1)).cast("int")
    raised = F.when(head == "", F.lit("1")).otherwise(F.concat(F.substring(bare, F.lit(1), F.length(bare) - 1), (last + 1).cast("string")))
    number = F.concat(raised, F.repeat(F.lit("0"), nines))
    at = F.instr(text, digits)
    changed = F.concat(F.substring(text, F.lit(1), at - 1), number, F.substring(text, at + F.length(digits), F.length(text)))
    return F.when(digits == "", text).otherwise(changed)


def entity_dropped(text: Column, entity: Column) -> Column:
    """Every place of the entity is cut out."""
    return F.when(F.coalesce(F.length(entity), F.lit(0)) == 0, text).otherwise(F.replace(text, entity, F.lit("")))


def condition_dropped(text: Column, markers: tuple[str, ...], tail: str = "，；。 ") -> Column:
    """The text ends before the first listed marker that it holds, and without trailing punctuation."""
    out = text
    for marker in reversed(markers):
        cut = F.rtrim(F.substring_index(text, marker, 1), F.lit(tail))
        out = F.when(F.contains(text, F.lit(marker)), cut).otherwise(out)
    return out


def claim_added(text: Column, claim: str) -> Column:
    return F.concat(text, F.lit(claim))
