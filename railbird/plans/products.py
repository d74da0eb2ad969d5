"""Query products: fixed questions answered over the racing tables.

``r`` has the tables by name: races, entries, tracks, horses, jockeys, changes, claims,
exotics, bets, crawl_events.  The date or instant to answer for is a parameter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from railbird.functions.times import live_status
from railbird.operators import aggregates as agg
from railbird.operators import betting, dedupe, filters, joins, ordering, sets, shapes
from railbird.streaming import health


def _of(races: DataFrame, children: DataFrame) -> DataFrame:
    """The rows of ``children`` that belong to some races; the filter goes down to their scan."""
    return joins.semi_by_ids(children, races, "race_id")


def _with_state(races: DataFrame, tracks: DataFrame, entries: DataFrame, claims: DataFrame, as_of: str) -> DataFrame:
    """Races with their track, entry counts, first three, claims flag and state at ``as_of``."""
    out = joins.join_track(races, tracks).join(agg.race_stats(entries), "race_id", "left")
    out = joins.exists_flag(out, claims, "race_id", "has_claims")
    state = live_status(F.col("race_date"), F.col("post_time"), F.col("race_status"), F.col("timezone"), F.size("top3") > 0, F.lit(as_of).cast("timestamp"))
    return out.withColumn("live_status", state)


def todays_races(r, day: str, as_of: str, track: str = "All", status: str = "All") -> DataFrame:
    today = r.races.where(F.col("race_date") == F.lit(day).cast("date"))
    rows = _with_state(today, r.tracks, _of(today, r.entries), _of(today, r.claims), as_of)
    return shapes.shape_race(filters.status(filters.track(rows, track), status))


def past_races(r, today: str, start: str = "", end: str = "", track: str = "All") -> DataFrame:
    """Finished, past and cancelled races up to today, with winner and first three."""
    old = r.races.where(F.col("race_status").isin("completed", "past_drf_only", "cancelled") & (F.col("race_date") <= F.lit(today).cast("date")))
    old = filters.track(joins.join_track(filters.view_dates(old, "all", today, start, end), r.tracks), track)
    out = old.join(agg.race_stats(r.entries), "race_id", "left").join(agg.race_winner(old, r.entries), "race_id", "left").join(r.horses.select(F.col("horse_id").alias("winner_horse_id"), F.col("horse_name").alias("winner_name")), "winner_horse_id", "left")
    return out.select(
        "race_id", "race_key", "track_code", F.coalesce("track_name", "track_code").alias("track_name"), "race_date", "race_number", "race_status",
        F.coalesce("winner_name", F.lit("N/A")).alias("winner_name"), "winner_number", F.coalesce("entry_count", F.lit(0)).cast("long").alias("entry_count"),
        F.coalesce(F.array_join(F.transform("top3", lambda x: x["program_number"]), "-"), F.lit("")).alias("results"),
    )


def race_cards(r, as_of: str, keys: DataFrame | None = None) -> DataFrame:
    """Races with nested entries, exotics and (completed ones) claims, neighbours on the card and state."""
    around = dedupe.prev_next_race(r.races).select("race_id", "prev_race_key", "next_race_key")
    races = r.races if keys is None else r.races.join(keys.select("race_key"), "race_key", "left_semi")
    entries = shapes.shape_entry(joins.join_entry_dims(r.entries, r.horses, r.jockeys))
    out = _with_state(races, r.tracks, r.entries, r.claims, as_of).drop("top3", "entry_count").join(around, "race_id")
    out = joins.nest(out, entries, "race_id", "entries", "entry_id")
    out = joins.nest(out, r.exotics, "race_id", "exotics", "seq")
    out = joins.nest(out, r.claims, "race_id", "claims", "claim_id")
    return out.withColumn("claims", F.when(F.col("race_status") == "completed", F.col("claims")).otherwise(F.slice("claims", 1, 0)))


def entries_for(r, day: str, track: str = "All", include_scratched: bool = True) -> DataFrame:
    races = filters.track(joins.join_track(r.races.where(F.col("race_date") == F.lit(day).cast("date")), r.tracks), track)
    rows = shapes.shape_entry(joins.join_entry_dims(filters.scratched(_of(races, r.entries), include_scratched), r.horses, r.jockeys))
    return races.select("race_id", "race_key", "track_code", "race_number").join(rows, "race_id")


def results_for(r, today: str, track: str = "All") -> DataFrame:
    races = filters.track(joins.join_track(r.races.where("race_status = 'completed'"), r.tracks), track).where(F.col("race_date") <= F.lit(today).cast("date"))
    top = dedupe.top_finishers(r.entries).join(r.horses, "horse_id", "left")
    return races.select("race_id", "race_key", "track_code", "race_date", "race_number").join(
        top.select("race_id", "finish_position", "program_number", "horse_name", "win_payout", "place_payout", "show_payout"), "race_id"
    )


def day_summary(r, day: str, as_of: str) -> DataFrame:
    races = r.races.where(F.col("race_date") == F.lit(day).cast("date"))
    entries = _of(races, r.entries)
    today = _with_state(races, r.tracks, entries, _of(races, r.claims), as_of)
    first = entries.where("finish_position = 1").groupBy("race_id").agg(F.min("horse_id").alias("horse_id")).join(r.horses.select("horse_id", F.col("horse_name").alias("winner_name")), "horse_id", "left")
    return agg.track_day_summary(today.join(first.drop("horse_id"), "race_id", "left"))


def filter_options(r, today: str) -> tuple[DataFrame, DataFrame]:
    """(dates up to today, tracks)."""
    return agg.distinct_dates(r.races, today), agg.distinct_tracks(r.tracks, {})


def _feed(r, races: DataFrame) -> DataFrame:
    flagged = joins.anti_detailed_scratch(r.entries, r.changes)
    rows = sets.union_change_sources(r.changes, flagged)
    looked = r.entries.join(r.horses, "horse_id", "left").select(F.col("entry_id").alias("_entry"), "horse_name", F.col("program_number").alias("_pgm"))
    # Changes without an entry match none; dealt by their own ids, so that they don't all come to the task of the null key.
    dealt = rows.withColumn("_deal", F.coalesce("entry_id", -1 - F.col("change_id")))
    named = dealt.join(looked, (F.col("_deal") == F.col("_entry")) & F.col("entry_id").isNotNull(), "left")
    rows = named.withColumn("program_number", F.coalesce("program_number", "_pgm")).drop("_pgm", "_deal", "_entry")
    # A change that names a number which no entry of the race has is an orphan.
    rows = rows.where(F.col("entry_id").isNotNull() | F.col("program_number").isNull())
    context = joins.join_track(races, r.tracks).select("race_id", "race_key", "race_date", "track_code", "track_name", "race_number", "post_time")
    return shapes.shape_change(joins.with_race(rows, context))


def change_feed(r, view: str, today: str, track: str = "All", start: str = "", end: str = "", race_wide: bool = False) -> DataFrame:
    """Told and flagged changes, one per event, without wagering and (unless asked for) race-wide ones."""
    races = filters.view_dates(r.races, view, today, start, end)
    rows = dedupe.dedupe_changes(filters.kept_changes(filters.track(_feed(r, races), track)))
    return filters.hide_race_wide(filters.without_wagering(rows), race_wide)


def feed_with_fallback(r, view: str, today: str, **options) -> tuple[DataFrame, str]:
    """(feed, view applied): all days if the upcoming view has nothing and no dates were given."""
    feed = change_feed(r, view, today, **options)
    if view == "upcoming" and not options.get("start") and not options.get("end") and feed.isEmpty():
        return change_feed(r, "all", today, **options), "all"
    return feed, view


def scratch_feed(r, view: str, today: str, track: str = "All") -> DataFrame:
    return shapes.shape_scratch(filters.scratch_items(change_feed(r, view, today, track)))


def race_changes(r, race_ids: DataFrame, include_race_wide: bool = False) -> DataFrame:
    races = r.races.join(race_ids.select("race_id"), "race_id", "left_semi")
    return filters.hide_race_wide(filters.without_wagering(dedupe.dedupe_changes(filters.kept_changes(_feed(r, races)))), include_race_wide)


def claims_feed(r, track: str = "All", start: str = "", end: str = "") -> DataFrame:
    races = filters.track(joins.join_track(filters.view_dates(r.races, "all", "9999-01-01", start, end), r.tracks), track)
    return shapes.shape_claim(joins.with_race(r.claims, races.drop("timezone")))


def _starts(r) -> DataFrame:
    return joins.with_race(r.entries, r.races.select("race_id", "race_key", "race_date", "track_code", "race_number", "race_status"))


def horses(r, search: str = "", with_races: bool = False) -> DataFrame:
    """Valid names with statistics; only horses with starts if asked for."""
    stats = agg.horse_stats(_starts(r))
    out = filters.horses_named(r.horses, search).join(stats, "horse_id", "inner" if with_races else "left")
    return out.fillna(0, ["starts", "wins", "places", "shows"]).fillna(0.0, ["win_pct"])


def horse_profiles(r, requests: DataFrame) -> DataFrame:
    """Statistics and earnings of the horses that ``requests`` (request) name without ambiguity."""
    found = joins.lookup_horse(requests, r.horses)
    return found.join(agg.horse_profile_stats(_starts(r)).hint("merge"), "horse_id", "left")


def horse_history(r, horse_ids: DataFrame) -> DataFrame:
    return shapes.shape_history(_starts(r).join(horse_ids.select("horse_id"), "horse_id", "left_semi"))


def system_health(r, as_of: str) -> DataFrame:
    return health.system_status(health.feed_public_status(health.feed_freshness(r.crawl_events, as_of)))


def settle_bets(r, as_of: str) -> DataFrame:
    return betting.settle(r.bets, r.races, r.entries, r.exotics, as_of)


def tracks(r) -> DataFrame:
    """All tracks by name."""
    return r.tracks.select("track_code", "track_name", "timezone").orderBy("track_name", "track_code")


def recent_uploads(uploads: DataFrame, limit: int = 10) -> DataFrame:
    """The latest uploads (upload_id, uploaded_at, …), at most a hundred."""
    return ordering.recent(uploads, "uploaded_at", "upload_id", ordering.clamp(limit, 100))


def recent_bets(r, limit: int = 50) -> DataFrame:
    return ordering.recent(r.bets, "created_at", "bet_id", ordering.clamp(limit, 200))
