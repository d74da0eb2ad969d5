"""Alerts of a stream with timers equal those of the table, with events out of order and feeds that fall silent."""

import datetime
import tempfile

from pyspark.sql import functions as F

from railbird.sources.views import Racing
from railbird.streaming import alerts, health

START = "2024-01-05 00:00:00"


def streamed(spark, events, parts):
    """Files by ``part``, read one a batch."""
    path = tempfile.mkdtemp(prefix="spark-")
    kept = events.withColumn("part", parts).cache()
    for k in sorted(r.part for r in kept.select("part").distinct().collect()):
        kept.where(F.col("part") == k).drop("part").coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(path)


def drained(df, name):
    df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", tempfile.mkdtemp(prefix="spark-")).trigger(availableNow=True).start().awaitTermination(600)
    return sorted(map(tuple, df.sparkSession.table(name).collect()))


def batch(events, end, step):
    told = health.alert_events(health.stale_alerts(health.stale_evaluations(events, START, str(end), step)))
    return sorted(map(tuple, told.select("feed", "at", "event", "severity", "count").collect()))


def test_shuffled_events_and_a_silent_feed(spark, sf):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    alerts.use_rocksdb(spark)
    try:
        events = Racing(spark, sf).crawl_events.withColumn("seen_at", F.col("seen_at").cast("timestamp")).where("seen_at < '2024-01-25'")
        # Results are silent from the 12th on; events of two days come in any order in four batches.
        events = events.where("feed <> 'results' OR seen_at < '2024-01-12'").cache()
        two_days = F.floor(F.unix_timestamp("seen_at") / 172_800)
        stream = streamed(spark, events, two_days * 2 + F.pmod(F.xxhash64("event_id"), F.lit(2)))
        got = drained(alerts.stream_alerts(stream, START, 47, 3, "3 days"), "timed")
        last = events.agg(F.max("seen_at")).first()[0]
        want = batch(events, last - datetime.timedelta(days=3), 47)
        assert got == want and len(want) > 10
        mine = [r for r in got if r[0] == "results"]
        assert mine[-1][2] == "opened"
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def test_an_alert_opens_in_silence_and_closes(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    alerts.use_rocksdb(spark)
    try:
        at = lambda h, m: f"2024-01-05 {h:02d}:{m:02d}:00"
        beats = [(i, "entries", "success", at(h, 30), i // 3) for i, h in enumerate(range(12))]
        own = [(50, "results", "success", at(1, 0), 1), (51, "results", "failure", at(3, 0), 1), (52, "results", "success", at(8, 5), 2)]  # the first comes late
        events = spark.createDataFrame(beats + own, "event_id int, feed string, kind string, seen_at string, k int").withColumn("seen_at", F.col("seen_at").cast("timestamp"))
        got = drained(alerts.stream_alerts(streamed(spark, events.drop("k"), F.when(F.col("event_id") < 50, F.floor(F.col("event_id") / 3)).otherwise(F.when(F.col("event_id") == 52, 2).otherwise(1))), START, 60, 3, "3 hours"), "silent")
        hour = lambda h: datetime.datetime(2024, 1, 5, h)
        assert [r[1:] for r in got if r[0] == "results"] == [(hour(4), "opened", "critical", 1)]  # stale at 2, 3 and 4; the watermark ends at 8:30
        assert got == batch(events, at(8, 30), 60)
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
