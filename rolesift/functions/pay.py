"""Pay ranges in running text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import clean

# The three range patterns, in order, and the target pay.
RANGE = r"(?i)\$\d[\d,]*\s*(?:-|to)\s*\$\d[\d,]*"
RANGE_K = r"(?i)\$\d[\d,]*K\s*(?:-|to)\s*\$\d[\d,]*K"
RANGE_LABELLED = r"(?i)Salary Range:\s*\$?\d[\d,]*(?:\.\d+)?\s*(?:-|to)\s*\$?\d[\d,]*(?:\.\d+)?"
TARGET_PAY = 250000
# Texts that say no pay is given.
NO_PAY = ["not disclosed", "unknown", "n/a", "na", "none", "not listed", "not provided"]


def _found(text: Column, pattern: str) -> Column:
    return F.nullif(F.trim(F.regexp_extract(text, pattern, 0)), F.lit(""))


def raw(text: Column) -> Column:
    """The first pay range in a text, '' when there is none."""
    labelled = F.trim(F.regexp_replace(_found(text, RANGE_LABELLED), r"^[^:]*:", ""))
    return F.coalesce(_found(text, RANGE), _found(text, RANGE_K), labelled, F.lit(""))


def amounts(text: Column) -> Column:
    """Every amount in a range as a number, K as thousands."""
    found = F.regexp_extract_all(text, F.lit(r"(?i)\$?\d[\d,]*(?:\.\d+)?K?"), F.lit(0))

    def value(item: Column) -> Column:
        bare = F.translate(F.upper(item), ",$", "")
        number = F.regexp_replace(bare, "K$", "").try_cast("double")
        return F.floor(number * F.when(bare.endswith("K"), 1000.0).otherwise(1.0))

    return F.filter(F.transform(found, value), lambda n: n.isNotNull())


def status(text: Column) -> Column:
    """'Qualified' from the target up, 'Below Target', or 'Unclear'."""
    top = F.array_max(amounts(text))
    return (
        F.when(top.isNull(), F.lit("Unclear"))
        .when(top < TARGET_PAY, F.lit("Below Target"))
        .otherwise(F.lit("Qualified"))
    )


def status_of_raw(raw_text: Column) -> Column:
    return F.when(raw_text == "", F.lit("Not Disclosed")).otherwise(status(raw_text))


def largest_number(c: Column) -> Column:
    """The largest plain number in a text, -1 when there is none."""
    found = F.regexp_extract_all(F.replace(clean(c), F.lit(",")), F.lit(r"\d+(?:\.\d+)?"), F.lit(0))
    return F.coalesce(F.array_max(F.transform(found, lambda n: n.try_cast("double"))), F.lit(-1.0))


def is_given(c: Column) -> Column:
    text = clean(c, False)
    return (text != "") & ~F.lower(text).isin(*NO_PAY)
