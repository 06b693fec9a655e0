"""Cleaning, normal forms, list settings and tokens."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WHITESPACE = " \t\n\r\x0b\x0c"

# Title parts that need the part after the comma.
CONTINUED_TITLE_PARTS = [
    "vice president",
    "senior vice president",
    "executive vice president",
    "assistant vice president",
    "associate vice president",
    "vp",
    "svp",
    "evp",
    "avp",
    "director",
    "senior director",
    "managing director",
    "head",
    "chief",
]
CONTINUED_TITLE_SUFFIXES = [" vice president", " director", " head", " chief"]
CONTINUED_TITLE_OF = ["vice president of", "head of", "director of"]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def bound(rows: DataFrame, new: dict[str, Column]) -> DataFrame:
    """The rows with new columns, worked out once each whatever uses them later.

    The optimizer writes a column's expression out wherever a later step names
    it; through ``let`` it cannot.
    """
    packed = rows.withColumn("_bound", let(F.struct(*[c.alias(k) for k, c in new.items()]), lambda s: s))
    return packed.withColumns({k: F.col(f"_bound.{k}") for k in new}).drop("_bound")


def strip(c: Column) -> Column:
    return F.trim(c, F.lit(WHITESPACE))


def clean(c: Column, nan_is_blank: bool = True) -> Column:
    """Trimmed text with NULL, and by default any-case 'nan', as ''."""
    text = strip(F.coalesce(c.cast("string"), F.lit("")))
    if not nan_is_blank:
        return text
    # A pattern names its input once; a CASE would compute it twice.
    return F.regexp_replace(text, "(?i)^nan$", "")


def or_default(c: Column, default: Column | str) -> Column:
    """The cleaned text, or the default where it is blank."""
    return F.coalesce(F.nullif(clean(c), F.lit("")), F.lit(default) if isinstance(default, str) else default)


def to_float(c: Column) -> Column:
    return F.nullif(clean(c), F.lit("")).try_cast("double")


def to_int(c: Column, default: int = 0) -> Column:
    return F.coalesce(to_float(c).try_cast("long"), F.lit(default).cast("long"))


def first_number(c: Column) -> Column:
    """The number inside a text such as 'Score: 82.5 / 100'."""
    return F.nullif(F.regexp_extract(clean(c), r"-?\d+(?:\.\d+)?", 0), F.lit("")).try_cast("double")


def squeeze(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"\s+", " "))


def norm_match(c: Column) -> Column:
    """Lower case, '/ - ,' as blanks, '&' as 'and': the matchers' form."""
    return squeeze(F.replace(F.translate(F.lower(clean(c, False)), "/-,", "   "), F.lit("&"), F.lit(" and ")))


def norm_plain(c: Column) -> Column:
    """As norm_match but '&' stays and 'nan' is blank: the URL-hint form."""
    return squeeze(F.translate(F.lower(clean(c)), "/-,", "   "))


def norm_term(c: Column) -> Column:
    """As norm_plain but commas stay: the synonym-lookup form."""
    return squeeze(F.translate(F.lower(clean(c, False)), "/-", "  "))


def norm_place(c: Column) -> Column:
    """Lower case, '&' as 'and', brackets and dashes as blanks."""
    text = F.replace(F.lower(clean(c)), F.lit("&"), F.lit(" and "))
    return squeeze(F.translate(text, "()[]-", "     "))


def norm_key(c: Column) -> Column:
    """Letters and digits only, single blanks between runs."""
    return strip(F.regexp_replace(F.lower(clean(c)), r"[^\p{L}\p{N}]+", " "))


def fold(c: Column) -> Column:
    """Single-blank, lower-case text: the title-group form."""
    return F.lower(squeeze(clean(c, False)))


def words(c: Column, min_length: int = 1) -> Column:
    """Distinct blank-separated tokens of an already normal text."""
    return F.array_distinct(F.filter(F.split(c, " "), lambda t: F.length(t) >= min_length))


def contains_any(text: Column, phrases: Iterable[str]) -> Column:
    """Substring test for any of a fixed list of plain phrases."""
    hit = F.lit(False)
    for phrase in phrases:
        hit = hit | text.contains(phrase)
    return hit


def first_marker(text: Column, markers: Iterable[str], label: Callable[[str], str]) -> Column:
    """label(first marker contained in text), NULL when none is."""
    return F.coalesce(*[F.when(text.contains(m), F.lit(label(m))) for m in markers])


def drop_blank(parts: Column) -> Column:
    return F.filter(F.transform(parts, strip), lambda p: p != "")


def split_csv(c: Column) -> Column:
    return drop_blank(F.split(clean(c, False), ","))


def _split_lines_or_semicolons(text: Column, otherwise: Column) -> Column:
    return (
        F.when(text == "", F.array().cast("array<string>"))
        .when(text.contains("\n"), drop_blank(F.split(text, r"\r\n|\n|\r")))
        .when(text.contains(";"), drop_blank(F.split(text, ";")))
        .otherwise(otherwise)
    )


def split_places(c: Column) -> Column:
    """Newlines, else ';', else the whole text as one place."""
    text = clean(c, False)
    return _split_lines_or_semicolons(text, F.array(text))


def _needs_more(norm: Column) -> Column:
    hit = norm.isin(*CONTINUED_TITLE_PARTS)
    for suffix in CONTINUED_TITLE_SUFFIXES:
        hit = hit | norm.endswith(suffix)
    return hit


def _merge_comma_titles(parts: Column) -> Column:
    """Join 'VP, IT' pairs and carry the prefix on to short follow-ups.

    A running fold: `held` waits for its second half, `prefix` is carried on.
    """
    empty = F.struct(
        F.array().cast("array<string>").alias("out"), F.lit("").alias("held"), F.lit("").alias("prefix")
    )

    def step(acc: Column, part: Column) -> Column:
        norm = norm_match(part)
        starts = (norm != "") & (_needs_more(norm) | norm.isin(*CONTINUED_TITLE_OF))
        short = (norm != "") & ~norm.isin(*CONTINUED_TITLE_PARTS) & (F.size(F.split(norm, " ")) <= 4)
        joins = (acc["held"] != "") & (norm != "")
        joined = F.concat(acc["held"], F.lit(", "), part)
        # A held part keeps its prefix only when it reads as one by itself.
        joined_prefix = F.when(_needs_more(norm_match(acc["held"])), acc["held"]).otherwise(F.lit(""))
        carried = (acc["prefix"] != "") & short
        return (
            F.when(
                joins,
                F.struct(
                    F.array_append(acc["out"], joined).alias("out"),
                    F.lit("").alias("held"),
                    joined_prefix.alias("prefix"),
                ),
            )
            .when(
                starts,
                F.struct(acc["out"].alias("out"), part.alias("held"), acc["prefix"].alias("prefix")),
            )
            .when(
                carried,
                F.struct(
                    F.array_append(acc["out"], F.concat(acc["prefix"], F.lit(", "), part)).alias("out"),
                    F.lit("").alias("held"),
                    acc["prefix"].alias("prefix"),
                ),
            )
            .otherwise(
                F.struct(
                    F.array_append(acc["out"], part).alias("out"),
                    F.lit("").alias("held"),
                    F.lit("").alias("prefix"),
                )
            )
        )

    def finish(acc: Column) -> Column:
        # The last part has nothing after it to join: it stands alone,
        # or under the carried prefix when it reads as a specialisation.
        held_norm = norm_match(acc["held"])
        short = ~held_norm.isin(*CONTINUED_TITLE_PARTS) & (F.size(F.split(held_norm, " ")) <= 4)
        tail = F.when(
            (acc["prefix"] != "") & short, F.concat(acc["prefix"], F.lit(", "), acc["held"])
        ).otherwise(acc["held"])
        return F.when(acc["held"] == "", acc["out"]).otherwise(F.array_append(acc["out"], tail))

    return F.when(F.size(parts) <= 1, parts).otherwise(F.aggregate(parts, empty, step, finish))


def split_titles(c: Column) -> Column:
    """Newlines, else ';', else commas with 'VP, IT' kept together."""
    text = clean(c, False)
    return _split_lines_or_semicolons(text, _merge_comma_titles(drop_blank(F.split(text, ","))))


def distinct_by(items: Column, key: Callable[[Column], Column]) -> Column:
    """First item of every non-blank key, order kept (an in-row list)."""
    keyed = F.filter(
        F.transform(items, lambda x: F.struct(key(x).alias("k"), strip(x).alias("v"))),
        lambda s: s["k"] != "",
    )
    return let(
        keyed,
        lambda ks: F.transform(
            F.filter(ks, lambda s, i: F.array_position(F.transform(ks, lambda o: o["k"]), s["k"]) == i + 1),
            lambda s: s["v"],
        ),
    )


def distinct_titles(items: Column) -> Column:
    return distinct_by(items, norm_match)
