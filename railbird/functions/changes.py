"""Classes and texts of late changes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from railbird.functions.names import squeeze

# A cancellation that mentions one of these is of a wager or the like, not of a race.
NOT_A_RACE = (
    "wagering", "simulcast", "pool", "turf racing", "superfecta", "trifecta", "exacta", "daily double", "pick", "quinella", "win", "place", "show", "omnibus",
)


def _has(text: Column, *parts: str) -> Column:
    out = text.contains(parts[0])
    for p in parts[1:]:
        out = out | text.contains(p)
    return out


def _low(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit("")))


def valid_cancellation(text: Column, word_boundary: bool = False) -> Column:
    """Says that a race is cancelled, and names no wager; by substrings, unless whole words are asked for."""
    low = _low(text)
    other = low.rlike(r"\b(" + "|".join(NOT_A_RACE) + r")\b") if word_boundary else _has(low, *NOT_A_RACE)
    return low.contains("cancel") & ~other


def change_type_class(change_type: Column, description: Column) -> Column:
    kind, text = _low(change_type), _low(description)
    return (
        F.when(kind.contains("scratch") | (text.contains("scratch") & text.contains("reason")), "scratch")
        .when(kind.contains("jockey"), "jockey")
        .when(kind.contains("weight"), "weight")
        .when(kind.contains("cancelled"), "cancelled")
        .otherwise("other")
    )


def change_type(description: Column) -> Column:
    """Of a line of a late-change page."""
    low = _low(description)
    return (
        F.when(low.contains("scratched"), "Scratch")
        .when(low.contains("jockey"), "Jockey Change")
        .when(low.contains("weight"), "Weight Change")
        .when(_has(low, "blinker", "equipment"), "Equipment Change")
        .when(_has(low, "first start since reported as", "reported as gelding"), "Horse Note")
        .when(valid_cancellation(description), "Race Cancelled")
        .when(low.contains("cancel") & _has(low, "wagering", "pool"), "Wagering")
        .otherwise("Other")
    )


def change_type_rss(line: Column) -> Column:
    """Of a line of a feed: knows post time changes, no horse notes."""
    low = _low(line)
    return (
        F.when(low.contains("scratched"), "Scratch")
        .when(low.contains("jockey"), "Jockey Change")
        .when(low.contains("weight"), "Weight Change")
        .when(low.contains("equipment"), "Equipment Change")
        .when(valid_cancellation(line), "Race Cancelled")
        .when(low.contains("post time") & low.contains("changed to"), "Post Time Change")
        .when(low.contains("cancel") & low.contains("wagering"), "Wagering")
        .otherwise("Other")
    )


def display_change_type(change_type: Column, description: Column) -> Column:
    """What a reader sees: 'Other' is refined by the description."""
    low = _low(description)
    return (
        F.when(F.coalesce(change_type, F.lit("Other")) != "Other", change_type)
        .when(low.rlike("scratch"), "Scratch")
        .when(low.rlike("jockey|rider"), "Jockey Change")
        .when(low.rlike("weight|overweight"), "Weight Change")
        .when(low.rlike("blinker|equipment"), "Equipment Change")
        .when(low.rlike("post time"), "Post Time Change")
        .when(low.rlike("gelding|first start"), "Horse Note")
        .when(low.rlike("wagering|pool"), "Wagering")
        .otherwise("Other")
    )


def is_race_wide(horse_name: Column) -> Column:
    return F.coalesce(horse_name, F.lit("")).isin("", "Race-wide", "Race-Wide")


def keep_change(horse_name: Column, change_type: Column, description: Column) -> Column:
    """Drops race-wide placeholders: horse matters without a horse, and rows that say nothing."""
    kind = _low(change_type)
    return (
        ~is_race_wide(horse_name)
        | ~_has(kind, "scratch", "jockey", "weight", "equipment") & (_has(kind, "cancelled", "post time") | (F.trim(F.coalesce(description, F.lit(""))) != ""))
    )


def is_wagering(change_type: Column, description: Column) -> Column:
    return (F.coalesce(change_type, F.lit("")) == "Wagering") | _low(description).contains("wagering")


def normalize_change_description(text: Column) -> Column:
    """Parts between semicolons once each, without a trailing '- Y' or '- N'."""
    clean = F.regexp_replace(squeeze(F.coalesce(text, F.lit(""))), r"\s*-\s+", " - ")
    parts = F.transform(F.split(clean, ";"), lambda p: F.trim(F.regexp_replace(F.trim(p), r"(?i)\s+-\s+[YN]$", "")))
    # An array of one binds the parts, which are worked out once and not for each of them.
    first = lambda kept: F.filter(kept, lambda p, i: ~F.exists(F.slice(kept, 1, i), lambda q: F.lower(q) == F.lower(p)))
    return F.array_join(F.get(F.transform(F.array(F.filter(parts, lambda p: p != "")), first), F.lit(0)), "; ")


def extract_new_post_time(text: Column) -> Column:
    return F.upper(F.nullif(F.regexp_extract(F.coalesce(text, F.lit("")), r"(?i)changed to\s+(\d{1,2}:\d{2}\s*(?:AM|PM)?)", 1), F.lit("")))
