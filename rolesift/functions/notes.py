"""Dates, durations, labelled notes and profile text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import clean

# The text forms a timestamp or a date may take.
TIMESTAMP_FORMATS = [
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd HH:mm:ss.SSSSSS",
    "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
    "yyyy-MM-dd'T'HH:mm:ss'Z'",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd HH:mm",
    "yyyy-MM-dd",
]
DATE_FORMATS = ["yyyy-MM-dd", "MM/dd/yyyy", "yyyy/MM/dd"]


def to_timestamp(c: Column) -> Column:
    text = F.nullif(clean(c), F.lit(""))
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in TIMESTAMP_FORMATS])


def to_day(c: Column) -> Column:
    text = F.nullif(clean(c), F.lit(""))
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)).cast("date") for f in DATE_FORMATS])


def iso_day(c: Column) -> Column:
    return F.try_to_timestamp(F.nullif(clean(c), F.lit("")), F.lit("yyyy-MM-dd")).cast("date")


def seconds_between(start: Column, end: Column) -> Column:
    """Whole seconds from one text timestamp to a later one, 0 if it is not later, NULL if either is none."""
    seconds = F.unix_timestamp(to_timestamp(end)) - F.unix_timestamp(to_timestamp(start))
    return F.when(seconds < 0, F.lit(0).cast("long")).otherwise(seconds)


def clock_text(seconds: Column) -> Column:
    """Seconds as 'hh:mm:ss'."""
    shown = F.format_string("%02d:%02d:%02d", F.floor(seconds / 3600), F.floor(seconds / 60) % 60, seconds % 60)
    return F.when(seconds.isNotNull(), shown)


def run_duration(started: Column, completed: Column, total_seconds: Column | None = None) -> Column:
    """A run's own total in seconds, else the time between its ends as a clock, else 'Unknown'."""
    clock = clock_text(seconds_between(started, completed))
    if total_seconds is None:
        return F.coalesce(clock, F.lit("Unknown"))
    own = F.nullif(clean(total_seconds), F.lit("")).try_cast("double")
    shown = F.when(own.isNotNull(), F.format_string("%.2fs", F.greatest(F.lit(0.0), own)))
    return F.coalesce(shown, clock, F.lit("Unknown"))


def number_after(notes: Column, *labels: str) -> Column:
    """The first positive integer that one of the labels says, 0 when none does."""
    said = [F.regexp_extract(F.coalesce(notes, F.lit("")), rf"{_literal(label)}:\s*(\d+)", 1).try_cast("long") for label in labels]
    return F.coalesce(*[F.nullif(n, F.lit(0).cast("long")) for n in said], F.lit(0).cast("long"))


def phrase_after(notes: Column, *labels: str) -> Column:
    """The first non-blank text that one of the labels says, up to a full stop or the line's end."""
    said = [F.trim(F.regexp_extract(F.coalesce(notes, F.lit("")), rf"{_literal(label)}:\s*(.*?)(?:\.|$)", 1)) for label in labels]
    return F.coalesce(*[F.nullif(t, F.lit("")) for t in said], F.lit(""))


def _literal(label: str) -> str:
    return "".join(c if c.isalnum() or c == " " else "\\" + c for c in label)


def line_items(output: Column, header: str) -> Column:
    """The '- ' lines right below a header line of a run's output."""
    lines = F.split(F.coalesce(output, F.lit("")), "\\r\\n|\\n|\\r")
    at = F.array_position(F.transform(lines, F.trim), header).cast("int")
    below = F.when(at > 0, F.slice(lines, at + 1, F.size(lines))).otherwise(F.array().cast("array<string>"))
    last = F.array_position(F.transform(below, lambda x: F.ltrim(x).startswith("- ")), False).cast("int")
    items = F.when(last > 0, F.slice(below, 1, last - 1)).otherwise(below)
    return F.transform(items, lambda x: F.substring(F.trim(x), 3, 1 << 30))


def profile_text(summary: Column, strengths: Column, resume: Column) -> Column:
    """What a profile says of its owner, the weightier sections first."""
    part = lambda head, c: F.when(clean(c, False) != "", F.concat(F.lit(f"{head}:\n"), clean(c, False)))
    first = F.nullif(F.concat_ws("\n\n", part("Executive Summary", summary), part("Strengths to Highlight", strengths)), F.lit(""))
    return F.concat_ws(
        "\n\n",
        F.concat(F.lit("High Priority Candidate Signals:\n"), first),
        F.concat(F.lit("Supporting Candidate Evidence:\n"), part("Resume Text", resume)),
    )


def truncated(c: Column, limit: int) -> Column:
    """Trimmed text, cut with a mark below it at ``limit``."""
    text = F.trim(F.coalesce(c, F.lit("")))
    cut = F.concat(F.rtrim(F.substring(text, 1, limit)), F.lit("\n\n[TRUNCATED]"))
    return F.when(F.length(text) > limit, cut).otherwise(text)
