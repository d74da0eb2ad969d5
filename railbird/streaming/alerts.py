"""Alerts from a stream of crawl events, by timers of event time.

A feed that falls silent sends nothing, so its freshness is evaluated at fixed instants: each feed has a
timer at its next one, and the watermark, which events of all feeds move on, sets it off.  Successes wait in the state until the
watermark has passed the instant that they count for, so the order in which events come, up to the watermark's delay, changes nothing.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from railbird.streaming.health import ALERT_EVENTS, STALE_MINUTES, STRIKES

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Timers need this store of states."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class StaleAlerts(StatefulProcessor):
    """Per feed: the next instant, the last success, how many instants in a row it was stale, whether an alert is open, how many there were."""

    def __init__(self, start_ms: int, step_ms: int, strikes: int):
        self.start_ms, self.step_ms, self.strikes = start_ms, step_ms, strikes

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.told = handle.getValueState("told", "next long, good long, strikes long, open boolean, count long")
        self.waiting = handle.getMapState("waiting", "at long", "seen boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803, ANN001
        if not self.told.exists():
            self.told.update((self.start_ms, -1, 0, False, 0))
            self.handle.registerTimer(self.start_ms)
        for r in rows:
            if r.good:
                self.waiting.updateValue((r.at_ms,), (True,))
        yield from ()

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803, ANN001
        """All instants that the watermark has passed, the feed's last one and those after it."""
        upto = timerValues.getCurrentWatermarkInMs()
        at, good, run, is_open, count = self.told.get()
        waiting = sorted(k[0] for k in self.waiting.keys()) if self.waiting.exists() else []
        used = 0
        limit = STALE_MINUTES[key[0]] if key[0] in STALE_MINUTES else None
        while at <= upto:
            while used < len(waiting) and waiting[used] <= at:
                good = waiting[used]
                used += 1
            stale = good < 0 or (limit is not None and (at // 1000 - good // 1000) // 60 > limit)
            run = run + 1 if stale else 0
            event = None
            if run >= self.strikes and not is_open:
                is_open, count, event = True, count + 1, "opened"
            elif not stale and is_open:
                is_open, event = False, "resolved"
            if event:
                instant = datetime.datetime.fromtimestamp(at / 1000, datetime.timezone.utc).replace(tzinfo=None)
                yield Row(feed=key[0], at=instant, event=event, severity="warning" if key[0] == "entries" else "critical", count=count)
            at += self.step_ms
        for t in waiting[:used]:
            self.waiting.removeKey((t,))
        self.told.update((at, good, run, is_open, count))
        self.handle.registerTimer(at)

    def close(self) -> None:
        pass


def stream_alerts(events: DataFrame, start: str, step_minutes: int, strikes: int = STRIKES, watermark: str = "1 hour") -> DataFrame:
    """A stream of crawl events (feed, kind, seen_at) -> alerts that open or are resolved (feed, at, event, severity, count).

    Every ``step_minutes`` from ``start`` (UTC) on, each feed that was ever seen is stale or not; an alert opens at the ``strikes``-th stale
    instant in a row and is resolved at the next fresh one.  The twin of ``health.stale_alerts`` over ``health.stale_evaluations`` up to the
    watermark.  The session's state store has to be RocksDB (``use_rocksdb``) and its time zone UTC.
    """
    begin = int(datetime.datetime.fromisoformat(start).replace(tzinfo=datetime.timezone.utc).timestamp() * 1000)
    supports = (F.col("kind") == "success") | ((F.col("kind") == "signal") & (F.col("feed") == "scratches"))
    dated = events.select("feed", F.coalesce(supports, F.lit(False)).alias("good"), F.col("seen_at").cast("timestamp").alias("seen_at"))
    told = dated.withColumn("at_ms", F.unix_millis("seen_at")).withWatermark("seen_at", watermark)
    return told.groupBy("feed").transformWithState(StaleAlerts(begin, step_minutes * 60_000, strikes), ALERT_EVENTS, "Append", "EventTime")
