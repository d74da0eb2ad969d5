"""Freshness of feeds, states of the system, and alerts, over a log of crawl events.

Events: event_id, feed, kind (attempt, success, failure, signal), seen_at, source.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from railbird.operators.dedupe import consecutive_runs, running

# Minutes after which a feed is stale, and the grace for work in progress and after a start.
STALE_MINUTES = {"entries": 300, "results": 30, "scratches": 20}
IN_PROGRESS_MINUTES, STARTUP_MINUTES, STRIKES, DATABASE_STRIKES = 20, 15, 3, 2


def _of_feed(values: dict[str, int]) -> Column:
    return F.create_map(*(F.lit(x) for kv in values.items() for x in kv))[F.col("feed")]


def feed_log(events: DataFrame) -> DataFrame:
    """Per feed: last attempt, success (a signal supports scratches) and failure.  Of a stream, a running table."""
    supports = (F.col("kind") == "success") | ((F.col("kind") == "signal") & (F.col("feed") == "scratches"))
    last = lambda c: F.max(F.when(c, F.col("seen_at")))
    return events.groupBy("feed").agg(F.max("seen_at").alias("last_attempt_at"), last(supports).alias("last_success_at"), last(F.col("kind") == "failure").alias("last_failure_at"))


def freshness_of(log: DataFrame, as_of: str, booted_at: str | None = None) -> DataFrame:
    """``feed_log`` with age, threshold and whether the feed is stale; in the first minutes after ``booted_at`` none is."""
    now = F.lit(as_of).cast("timestamp")
    minutes = lambda c: F.floor((F.unix_timestamp(now) - F.unix_timestamp(c)) / 60)
    booting = F.lit(False) if booted_at is None else minutes(F.lit(booted_at).cast("timestamp")) < STARTUP_MINUTES
    age, limit = minutes(F.col("last_success_at")), _of_feed(STALE_MINUTES)
    late = F.coalesce(age > limit, F.lit(True))
    busy = late & (minutes(F.col("last_attempt_at")) < IN_PROGRESS_MINUTES) & (F.coalesce(F.col("last_failure_at") < F.col("last_attempt_at"), F.lit(True)))
    return log.select("*", age.alias("age_minutes"), limit.alias("threshold_minutes"), booting.alias("within_startup_grace"), busy.alias("in_progress"), (late & ~busy & ~booting).alias("stale"))


def feed_freshness(events: DataFrame, as_of: str, booted_at: str | None = None) -> DataFrame:
    """Freshness of each feed from the events up to ``as_of``."""
    return freshness_of(feed_log(events.where(F.col("seen_at") <= F.lit(as_of).cast("timestamp"))), as_of, booted_at)


def stream_freshness(events: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, as_of: Callable[[], str], booted_at: str | None = None, trigger: dict | None = None):
    """A stream of events -> after each batch, ``feed_freshness`` of all events so far at the instant that ``as_of`` gives,
    handed to ``sink`` (rows, batch id).  The state is a row per feed."""

    def each(log: DataFrame, n: int) -> None:
        sink(freshness_of(log, as_of(), booted_at), n)

    return feed_log(events).writeStream.outputMode("complete").foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "1 minute"})).start()


def feed_public_status(freshness: DataFrame) -> DataFrame:
    failed_last = F.coalesce(F.col("last_failure_at") == F.col("last_attempt_at"), F.lit(False))
    status = (
        F.when(F.col("within_startup_grace") & F.col("last_success_at").isNull(), "starting")
        .when(F.col("stale") & ~failed_last, "recovering")
        .when(F.col("stale"), "attention_needed")
        .when(F.col("in_progress"), "running")
        .otherwise("ok")
    )
    return freshness.withColumn("public_status", status)


def system_status(feeds: DataFrame) -> DataFrame:
    """One row: the worst state decides, and how many feeds are in each."""
    n = lambda s: F.count_if(F.col("public_status") == s)
    out = feeds.agg(F.count("*").alias("feeds"), n("attention_needed").alias("attention"), n("recovering").alias("recovering"), n("starting").alias("starting"), n("running").alias("running"))
    state = F.when(F.col("feeds") == 0, "unknown").when(F.col("attention") > 0, "degraded").when(F.col("recovering") > 0, "recovering").when(F.col("starting") > 0, "starting").otherwise("operational")
    return out.withColumn("status", state)


def _hour(column: str) -> Column:
    return F.date_trunc("HOUR", column)


def stale_evaluations(events: DataFrame, start: str, end: str, step_minutes: int) -> DataFrame:
    """feed, evaluated_at, stale: the feed's freshness at each step."""
    ticks = events.select("feed").distinct().select("feed", F.explode(F.sequence(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp"), F.expr(f"INTERVAL {step_minutes} MINUTES"))).alias("evaluated_at"))
    good = events.where((F.col("kind") == "success") | ((F.col("kind") == "signal") & (F.col("feed") == "scratches"))).select("feed", F.col("seen_at").cast("timestamp").alias("evaluated_at"), F.lit(1).alias("good"))
    both = ticks.withColumn("good", F.lit(0)).unionByName(good)
    seen = running(both, ("feed",), _hour("evaluated_at"), ["evaluated_at", F.desc("good")], last_good=("max", F.when(F.col("good") == 1, F.col("evaluated_at")))).where("good = 0")
    age = (F.unix_timestamp("evaluated_at") - F.unix_timestamp("last_good")) / 60
    return seen.select("feed", "evaluated_at", F.coalesce(F.floor(age) > _of_feed(STALE_MINUTES), F.lit(True)).alias("stale"))


def severity_of(feed: Column) -> Column:
    return F.when(feed == "entries", "warning").otherwise("critical")


def stale_alerts(evaluations: DataFrame, strikes: int = STRIKES, bucket: Column | None = None) -> DataFrame:
    """feed, opened_at, resolved_at, severity: an alert opens at the ``strikes``-th stale evaluation in a row and
    resolves at the next fresh one (null: still open).  ``bucket`` cuts a feed's evaluations, by default by the hour."""
    cut = _hour("evaluated_at") if bucket is None else bucket
    fresh = F.when(F.col("stale"), 0).otherwise(1)
    islands = running(evaluations.withColumn("_cut", cut), ("feed",), F.col("_cut"), ["evaluated_at"], island=("sum", fresh))
    counted = consecutive_runs(islands, ("feed",), "evaluated_at", "stale", F.col("_cut"))
    opened = counted.where(F.col("run") == strikes).select("feed", "island", F.col("evaluated_at").alias("opened_at"))
    ends = islands.where("NOT stale").select("feed", (F.col("island") - 1).alias("island"), F.col("evaluated_at").alias("resolved_at"))
    return opened.join(ends, ["feed", "island"], "left").select("feed", "opened_at", "resolved_at", severity_of(F.col("feed")).alias("severity"))


def failure_bursts(events: DataFrame, least: int = STRIKES, seconds: int = 900) -> DataFrame:
    """Failures that are at least the ``least``-th in the time before them since the feed's last success."""
    if seconds > 3600:
        raise ValueError("a burst is at most an hour long")
    since = running(events, ("feed",), _hour("seen_at"), ["seen_at", "event_id"], _s=("sum", (F.col("kind") == "success").cast("int"))).where("kind = 'failure'")
    # Each failure stands in its own hour, and in the next one if that may look back at it.
    at = since.withColumn("_t", F.unix_timestamp("seen_at"))
    hour = F.floor(F.col("_t") / 3600)
    reach = F.array_distinct(F.array(hour, F.floor((F.col("_t") + seconds) / 3600)))
    trailing = Window.partitionBy("feed", "_s", "_hour").orderBy("_t").rangeBetween(-seconds, 0)
    counted = at.withColumn("_hour", F.explode(reach)).withColumn("failures", F.count("*").over(trailing)).where(F.col("_hour") == hour)
    return counted.where(F.col("failures") >= least).select("event_id", "feed", "seen_at", "failures")


ALERT_EVENTS = "feed string, at timestamp, event string, severity string, count long"
_ALERT_STATE = "strikes long, open boolean, count long"


def stream_stale_alerts(evaluations: DataFrame, strikes: int = STRIKES, watermark: str = "1 hour") -> DataFrame:
    """A stream of evaluations (feed, evaluated_at, stale) -> what has to be told: an alert that opens or is resolved.

    Per feed the state is a count and a flag.  Evaluations are taken in the order of their time within a batch;
    batches are taken to follow each other in time.  count is how often the alert has opened.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, is_open, count = state.get if state.exists else (0, False, 0)
        out = []
        for e in pd.concat(list(frames)).sort_values("evaluated_at").itertuples():
            n = n + 1 if e.stale else 0
            if n >= strikes and not is_open:
                is_open, count = True, count + 1
                out.append((key[0], e.evaluated_at, "opened", "warning" if key[0] == "entries" else "critical", count))
            elif not e.stale and is_open:
                is_open = False
                out.append((key[0], e.evaluated_at, "resolved", "warning" if key[0] == "entries" else "critical", count))
        state.update((n, is_open, count))
        yield pd.DataFrame(out, columns=["feed", "at", "event", "severity", "count"]).astype({"at": "datetime64[us]"})

    dated = evaluations.withColumn("evaluated_at", F.col("evaluated_at").cast("timestamp")).withWatermark("evaluated_at", watermark)
    return dated.groupBy("feed").applyInPandasWithState(step, ALERT_EVENTS, _ALERT_STATE, "append", GroupStateTimeout.NoTimeout)


def alert_events(alerts: DataFrame) -> DataFrame:
    """Rows of ``stale_alerts`` as ``stream_stale_alerts`` tells them."""
    count = F.row_number().over(Window.partitionBy("feed").orderBy("opened_at")).cast("long")  # a row per opening, not per evaluation
    both = alerts.withColumn("count", count).select("feed", "severity", "count", F.explode(F.array(F.struct(F.col("opened_at").alias("at"), F.lit("opened").alias("event")), F.struct(F.col("resolved_at").alias("at"), F.lit("resolved").alias("event")))).alias("e"))
    return both.where("e.at IS NOT NULL").select("feed", F.col("e.at").alias("at"), "e.event", "severity", "count")


def alert_lifecycle(signals: DataFrame, told: DataFrame | None = None, keep: int = 50) -> DataFrame:
    """(key, at, is_open) -> per key: count of openings, first and last seen, opened_at and resolved_at of the last
    alert, open or resolved, and whether that was told of; the latest ``keep`` keys.

    ``told`` (key, at, event: opened or resolved) are notifications that went out.  An alert that opens again
    is a new one: nothing of it has been told.
    """
    kind = signals.schema["at"].dataType
    at = lambda c, how=F.max: how(F.when(c, F.col("at")))
    o = F.col("is_open")
    ends = signals.groupBy("key").agg(
        F.count_if(o).alias("count"), F.min("at").alias("first_seen"), F.max("at").alias("last_seen"), F.max_by("is_open", F.struct("at", "is_open")).alias("open"), at(o).alias("_last_open")
    )
    seen = signals.join(ends.select("key", "_last_open"), "key")
    before = seen.where(~o & (F.col("at") < F.col("_last_open"))).groupBy("key").agg(F.max("at").alias("_closed"))
    turns = seen.join(before, "key", "left").groupBy("key").agg(
        at(o & F.coalesce(F.col("at") > F.col("_closed"), F.lit(True)), F.min).alias("opened_at"), at(~o & (F.col("at") > F.col("_last_open")), F.min).alias("resolved_at")
    )
    said = signals.sparkSession.createDataFrame([], f"key string, at {kind.simpleString()}, event string") if told is None else told
    last = said.groupBy("key").agg(at(F.col("event") == "opened").alias("_told_open"), at(F.col("event") == "resolved").alias("_told_end"))
    out = ends.drop("_last_open").join(turns, "key").join(last, "key", "left")
    flag = lambda told_at, since: F.coalesce(F.col(told_at) >= F.col(since), F.lit(False))
    out = out.withColumns({"notified_open": flag("_told_open", "opened_at"), "notified_resolved": flag("_told_end", "resolved_at")}).drop("_told_open", "_told_end")
    return out.orderBy(F.desc("first_seen"), "key").limit(keep)


def pending_notifications(alerts: DataFrame) -> DataFrame:
    """Alerts whose opening or end nobody was told of; needs open, notified_open, notified_resolved."""
    event = F.when(F.col("open") & ~F.col("notified_open"), "opened").when(~F.col("open") & F.col("notified_open") & ~F.col("notified_resolved"), "resolved")
    return alerts.withColumn("event", event).where("event IS NOT NULL")


def scratch_activity(events: DataFrame) -> DataFrame:
    return events.where("feed = 'scratches' AND kind IN ('signal', 'success')").agg(F.count("*").alias("events"), F.max("seen_at").alias("last_at"), F.max_by("source", F.struct("seen_at", "event_id")).alias("last_source"))


def zero_activity(total: DataFrame, as_of: str) -> DataFrame:
    from railbird.functions.times import racing_hours

    return total.where((F.col("total") == 0) & racing_hours(F.lit(as_of).cast("timestamp"))).select(F.lit("zero_races").alias("key"), F.lit("critical").alias("severity"))


def stream_failure_bursts(events: DataFrame, least: int = STRIKES, seconds: int = 900, watermark: str = "1 hour") -> DataFrame:
    """``failure_bursts`` of a stream: per feed the state is the times of failures since the last success, ``seconds`` back."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        times = list(state.get[0]) if state.exists else []
        out = []
        for e in pd.concat(list(frames)).sort_values(["seen_at", "event_id"]).itertuples():
            now = int(e.seen_at.timestamp())
            if e.kind == "success":
                times = []
            elif e.kind == "failure":
                times = [t for t in times if t >= now - seconds] + [now]
                if len(times) >= least:
                    out.append((e.event_id, key[0], e.seen_at, len(times)))
        state.update((times,))
        yield pd.DataFrame(out, columns=["event_id", "feed", "seen_at", "failures"]).astype({"event_id": "int64", "seen_at": "datetime64[us]", "failures": "int64"})

    dated = events.withColumn("seen_at", F.col("seen_at").cast("timestamp")).withWatermark("seen_at", watermark)
    return dated.groupBy("feed").applyInPandasWithState(step, "event_id long, feed string, seen_at timestamp, failures long", "times array<long>", "append", GroupStateTimeout.NoTimeout)
