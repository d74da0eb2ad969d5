"""Dates, post times, and states that depend on the clock; the clock is a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GRACE_MINUTES = 20
DEFAULT_ZONE = "America/New_York"
# Offsets of the zone names that feeds use.
OFFSETS = {"GMT": "+0000", "UTC": "+0000", "EST": "-0500", "EDT": "-0400", "CST": "-0600", "CDT": "-0500", "MST": "-0700", "MDT": "-0600", "PST": "-0800", "PDT": "-0700"}


def clean_time(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"Post [Tt]ime", ""), r"(ET|PT|CT|MT)", ""))


def _clock(text: Column) -> Column:
    """The time of day as a timestamp on some day; null if it can't be read."""
    t = F.upper(clean_time(text))
    spaced = F.regexp_replace(t, r"^(\d{1,2}:\d{2})\s*(AM|PM)$", "$1 $2")
    return F.coalesce(
        F.when(t.rlike(r"^\d{1,2}:\d{2}:\d{2}$"), F.try_to_timestamp(F.concat(F.lit("2000-01-01 "), t), F.lit("yyyy-MM-dd H:mm:ss"))),
        F.when(t.rlike(r"^\d{1,2}:\d{2}$"), F.try_to_timestamp(F.concat(F.lit("2000-01-01 "), t), F.lit("yyyy-MM-dd H:mm"))),
        F.when(spaced.rlike(r"^\d{1,2}:\d{2} (AM|PM)$"), F.try_to_timestamp(F.concat(F.lit("2000-01-01 "), spaced), F.lit("yyyy-MM-dd h:mm a"))),
    )


def format_12h(text: Column) -> Column:
    """'14:05:00' -> '2:05 PM'; what can't be read stays."""
    return F.coalesce(F.when(~text.isin("", "N/A", "TBD"), F.date_format(_clock(text), "h:mm a")), text)


def post_ts(race_date: Column, post_time: Column, zone: Column) -> Column:
    """The instant of a post time at a track."""
    local = F.concat(race_date.cast("string"), F.date_format(_clock(post_time), " HH:mm:ss"))
    return F.to_utc_timestamp(F.try_to_timestamp(local, F.lit("yyyy-MM-dd HH:mm:ss")), F.coalesce(zone, F.lit(DEFAULT_ZONE)))


def live_status(race_date: Column, post_time: Column, stored: Column, zone: Column, has_results: Column, as_of: Column, grace_minutes: int = GRACE_MINUTES) -> Column:
    """The state of a race at ``as_of``."""
    at = post_ts(race_date, post_time, zone)
    return (
        F.when(F.coalesce(has_results, F.lit(False)) | (stored == "completed"), "completed")
        .when(stored.isin("cancelled", "delayed", "results_unavailable"), stored)
        .when(stored == "past_drf_only", "past")
        .when(at.isNull(), F.coalesce(F.nullif(stored, F.lit("")), F.lit("upcoming")))
        .when(as_of >= at + F.expr(f"INTERVAL {grace_minutes} MINUTES"), "past")
        .otherwise("upcoming")
    )


def initial_status(race_date: Column, today: Column) -> Column:
    return F.when(race_date < today, "past_drf_only").otherwise("upcoming")


def preserve_status(old: Column) -> Column:
    return F.coalesce(old, F.lit("upcoming"))


def age_minutes(at: Column, as_of: Column) -> Column:
    return F.floor((F.unix_timestamp(as_of) - F.unix_timestamp(at)) / 60)


def is_stale(at: Column, as_of: Column, minutes: Column) -> Column:
    """Never seen is stale."""
    return F.coalesce(age_minutes(at, as_of) > minutes, F.lit(True))


def racing_hours(at: Column) -> Column:
    return F.hour(F.from_utc_timestamp(at, DEFAULT_ZONE)).between(8, 23)


def parse_rfc822_date(text: Column) -> Column:
    """The date, in its own zone, of 'Tue, 06 Jan 2026 10:15:00 EST'."""
    return F.to_date(F.try_to_timestamp(F.regexp_extract(F.coalesce(text, F.lit("")), r"(\d{1,2} [A-Za-z]{3} \d{4})", 1), F.lit("d MMM yyyy")))


def rfc822_instant(text: Column) -> Column:
    bare = F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), r"^[A-Za-z]+,\s*", "")
    for name, offset in OFFSETS.items():
        bare = F.regexp_replace(bare, rf"\b{name}$", offset)
    return F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm:ss Z"))


def parse_text_date(text: Column) -> Column:
    """The first date in a text: (M/D/YYYY) or M/D/YYYY, MONTH D, YYYY, or Mon D, YYYY."""
    t = F.initcap(F.coalesce(text, F.lit("")))
    words = F.regexp_replace(F.regexp_extract(t, r"((?:January|February|March|April|May|June|July|August|September|October|November|December) \d{1,2},? \d{4})", 1), ",", "")
    short = F.regexp_replace(F.regexp_extract(t, r"((?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec) \d{1,2},? \d{4})", 1), ",", "")
    return F.to_date(
        F.coalesce(
            F.try_to_timestamp(F.regexp_extract(t, r"(\d{1,2}/\d{1,2}/\d{4})", 1), F.lit("M/d/yyyy")),
            F.try_to_timestamp(words, F.lit("MMMM d yyyy")),
            F.try_to_timestamp(short, F.lit("MMM d yyyy")),
        )
    )
