"""Filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from railbird.functions import changes, names


def ilike(column: Column, text: str) -> Column:
    """Contains, whatever the case; % and _ in ``text`` match anything."""
    return column.ilike(f"%{text}%")


def not_placeholder(column: Column) -> Column:
    return ~column.like("$%") & ~column.isin("-", "--", "N/A")


def active_tracks(races: DataFrame, date: str) -> DataFrame:
    """Tracks with a race key of the day (yyyy-mm-dd), by key pattern alone."""
    return races.where(F.col("race_key").like(f"%-{date.replace('-', '')}-%")).select(F.split_part("race_key", F.lit("-"), F.lit(1)).alias("track_code")).distinct()


def view_dates(df: DataFrame, mode: str, today: str, start: str = "", end: str = "", column: str = "race_date") -> DataFrame:
    """upcoming: of today; history: before; all.  ``start`` replaces this, ``end`` adds a bound."""
    day = F.col(column)
    if start:
        df = df.where(day >= F.lit(start).cast("date"))
    elif mode == "upcoming":
        df = df.where(day == F.lit(today).cast("date"))
    elif mode == "history":
        df = df.where(day < F.lit(today).cast("date"))
    return df.where(day <= F.lit(end).cast("date")) if end else df


def track(df: DataFrame, wanted: str, code: str = "track_code", name: str = "track_name") -> DataFrame:
    """By code or name; '' and 'All' are no filter."""
    return df if wanted in ("", "All") else df.where((F.col(code) == wanted) | (F.col(name) == wanted))


def status(df: DataFrame, wanted: str, column: str = "live_status") -> DataFrame:
    """Only Upcoming and Completed restrict, in any case."""
    return df.where(F.lower(column) == wanted.lower()) if wanted.lower() in ("upcoming", "completed") else df


def scratched(df: DataFrame, include: bool) -> DataFrame:
    return df if include else df.where(~F.coalesce("scratched", F.lit(False)))


def kept_changes(df: DataFrame) -> DataFrame:
    return df.where(changes.keep_change(F.col("horse_name"), F.col("change_type"), F.col("description")))


def without_wagering(df: DataFrame) -> DataFrame:
    return df.where(~changes.is_wagering(F.col("change_type"), F.col("description")))


def hide_race_wide(df: DataFrame, include: bool = False) -> DataFrame:
    return df if include else df.where(~changes.is_race_wide(F.col("horse_name")) & F.col("entry_id").isNotNull())


def scratch_items(df: DataFrame) -> DataFrame:
    return df.where(changes.change_type_class(F.col("change_type"), F.col("description")) == "scratch")


def valid_programs(df: DataFrame, column: str = "program_number") -> tuple[DataFrame, DataFrame]:
    """(good rows, quarantined rows): no number, '' and '0' are no program numbers."""
    good = F.coalesce(F.trim(F.col(column)).isin("", "0") == F.lit(False), F.lit(False))
    return df.where(good), df.where(~good)


# What pages of a wall, and pages of a missing card, have in them; lower case.
BLOCKED_MARKS = ("visid_incap", "incap_ses", "request unsuccessful", "access denied", "incapsula")
NO_CARD_MARKS = ("404 - file or directory not found", "<title>404")
SHORT_PAGE = 5000


def classify_page(html: Column, size: Column | None = None) -> Column:
    """blocked, no_card or success.  A short page is blocked, unless it is a 404 without marks of a wall; one
    without a known size (by default its length, 0 counts as unknown) is never short."""
    low = F.lower(F.coalesce(html, F.lit("")))
    n = F.coalesce(F.length(html) if size is None else size, F.lit(0))
    short = (n > 0) & (n < SHORT_PAGE)
    has = lambda marks: F.exists(F.array(*map(F.lit, marks)), lambda m: low.contains(m))
    return F.when(short & has(BLOCKED_MARKS), "blocked").when(has(NO_CARD_MARKS), "no_card").when(short, "blocked").otherwise("success")


def fresh(df: DataFrame, published: str, day: str) -> DataFrame:
    """Documents of the day; no date passes, an unreadable one doesn't (``published`` is text)."""
    from railbird.functions.times import parse_rfc822_date

    blank = F.trim(F.coalesce(F.col(published), F.lit(""))) == ""
    return df.where(blank | (parse_rfc822_date(F.col(published)) == F.lit(day).cast("date")))


def search_results(df: DataFrame, text: str) -> DataFrame:
    return df.where(F.lower("track_name").contains(text.lower()) | F.lower(F.coalesce("winner_name", F.lit(""))).contains(text.lower()))


def schedule_skip(df: DataFrame, column: str = "has_card") -> DataFrame:
    """Goes only when the schedule says no, not when it doesn't know."""
    return df.where(F.coalesce(F.col(column), F.lit(True)))


def horses_named(df: DataFrame, search: str = "") -> DataFrame:
    out = df.where(names.valid_horse_name(F.col("horse_name")))
    return out.where(ilike(F.col("horse_name"), search)) if search else out
