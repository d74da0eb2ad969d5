"""Writes, versions, streams against their batch twins."""

import tempfile

from pyspark.sql import functions as F

from railbird.operators import betting
from railbird.sources import tables
from railbird.sources.views import EVENTS_AS_OF, Racing
from railbird.streaming import changes, health


def test_upsert_is_idempotent_and_null_safe(spark):
    old = spark.createDataFrame([(1, "a", 1), (None, "a", 2)], "k int, c string, v int")
    new = spark.createDataFrame([(1, "a", 9), (1, "a", 8), (None, "a", 7), (2, "b", 3)], "k int, c string, v int")
    once = tables.upsert(old, new, ["k", "c"], ["v"])
    want = {(1, "a", 9), (None, "a", 7), (2, "b", 3)}
    assert {tuple(r) for r in once.select("k", "c", "v").collect()} == want
    assert {tuple(r) for r in tables.upsert(once, new, ["k", "c"], ["v"]).select("k", "c", "v").collect()} == want


def test_snapshots(spark):
    path = tempfile.mkdtemp(prefix="spark-")
    one = spark.createDataFrame([(1,)], "total int")
    tables.write_snapshot(one, path, "day", "2026-01-01 10:00:00")
    tables.write_snapshot(one.withColumn("total", F.lit(2)), path, "day", "2026-01-01 11:00:00")
    assert [r.total for r in tables.read_snapshot(spark, path, "day").collect()] == [2]


def test_rss_files(spark):
    path = tempfile.mkdtemp(prefix="spark-")
    with open(f"{path}/AQU-USA.rss", "w") as f:
        f.write("<rss><channel><item><description>Race 01: &lt;i&gt;Race Cancelled&lt;/i&gt; - Weather</description><pubDate>Tue, 06 Jan 2026 10:00:00 EST</pubDate></item></channel></rss>")
    item = tables.read_rss_items(spark, path).first()
    assert item.track_code == "AQU" and "<i>Race Cancelled</i>" in item.description and item.published.startswith("Tue")


def test_stream_changes_equals_batch(spark):
    from railbird.operators.extract import extract_rss_changes

    path, out = tempfile.mkdtemp(prefix="spark-"), tempfile.mkdtemp(prefix="spark-")
    docs = spark.createDataFrame([(i, "GP", f"Race {i}: # {i} Some Horse Scratched - Vet<br/>Race {i}: Post Time changed to 1:30 PM") for i in range(1, 9)], "doc_id long, track_code string, description string")
    docs.repartition(3).write.mode("append").parquet(path)
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(path)
    q = changes.stream_changes(stream, lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}"), tempfile.mkdtemp(prefix="spark-"), {"availableNow": True})
    q.awaitTermination(120)
    got = spark.read.parquet(out).drop("batch")
    assert sorted(map(str, got.collect())) == sorted(map(str, extract_rss_changes(docs).select(got.columns).collect()))


def test_stream_dedupe(spark, sf):
    path = tempfile.mkdtemp(prefix="spark-")
    events = Racing(spark, sf).crawl_events
    events.union(events).repartition(4).write.mode("append").parquet(path)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(path)
    q = changes.stream_dedupe(stream, ["event_id"], "seen_at", "90 days").writeStream.format("memory").queryName("seen").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("seen").count() == events.count()


def streamed(spark, rows, column, parts=6):
    """``rows`` as a stream whose batches follow each other in time."""
    path = tempfile.mkdtemp(prefix="spark-")
    kept = rows.cache()
    ends = kept.agg(F.min(column).alias("a"), F.max(column).alias("b")).first()
    step = (ends.b - ends.a) / parts
    for k in range(parts):
        low, high = ends.a + k * step, ends.a + (k + 1) * step
        part = kept.where((F.col(column) >= F.lit(low)) & ((F.col(column) < F.lit(high)) | F.lit(k == parts - 1)))
        part.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


def drained(df, name):
    df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start().awaitTermination(300)
    return df.sparkSession.table(name)


def test_streamed_freshness_equals_batch(spark, sf):
    events = Racing(spark, sf).crawl_events.where(F.col("seen_at") <= F.lit(EVENTS_AS_OF).cast("timestamp"))
    got = {}
    q = health.stream_freshness(streamed(spark, events, "seen_at"), lambda df, n: got.update({n: sorted(map(str, df.collect()))}), tempfile.mkdtemp(prefix="spark-"), lambda: EVENTS_AS_OF, trigger={"availableNow": True})
    q.awaitTermination(300)
    assert len(got) == 6 and got[max(got)] == sorted(map(str, health.feed_freshness(events, EVENTS_AS_OF).collect())) != got[0]


def test_streamed_bursts_equal_batch(spark, sf):
    events = Racing(spark, sf).crawl_events.withColumn("seen_at", F.col("seen_at").cast("timestamp"))
    for least, seconds in ((2, 3600), (3, 3000), (1, 900)):
        got = drained(health.stream_failure_bursts(streamed(spark, events, "seen_at"), least, seconds, "90 days"), f"bursts{least}")
        want = health.failure_bursts(events, least, seconds)
        assert want.count() > 0 and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(got.columns).collect()))


def test_streamed_stale_alerts_equal_batch(spark, sf):
    events = Racing(spark, sf).crawl_events
    seen = health.stale_evaluations(events, "2024-01-05 00:00:00", "2024-01-25 00:00:00", 45)
    want = health.alert_events(health.stale_alerts(seen))
    got = drained(health.stream_stale_alerts(streamed(spark, seen, "evaluated_at")), "alerts")
    assert want.count() > 3 and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(got.columns).collect()))


def test_running_totals_do_not_depend_on_the_buckets(spark):
    from railbird.operators import dedupe

    rows = spark.createDataFrame([(k, i, (i * 7 + len(k or "")) % 5, i % 3 > 0) for k in ("a", "bb", None) for i in range(40)], "k string, i int, x int, bad boolean")
    one = None
    for size in (1, 7, 1000):
        bucket = F.floor(F.col("i") / size)
        summed = dedupe.running(rows, ("k",), bucket, ["i"], s=("sum", F.col("x")), m=("max", F.when(F.col("x") > 2, F.col("i"))))
        both = sorted(map(str, summed.collect())), sorted(map(str, dedupe.consecutive_runs(rows, ("k",), "i", "bad", bucket).collect()))
        one = one or both
        assert both == one and len(both[0]) == 120
    assert {r.run for r in dedupe.consecutive_runs(rows, ("k",), "i", "bad").collect()} == {0, 1, 2}


def test_alerts_that_open_again_are_untold(spark):
    rows = [("a", 1, True), ("a", 2, False), ("a", 5, True), ("b", 1, True), ("b", 3, False), ("c", 4, False), ("d", 1, True), ("d", 2, True)]
    told = [("a", 1, "opened"), ("a", 2, "resolved"), ("b", 1, "opened"), ("b", 3, "resolved"), ("d", 2, "opened")]
    s, t = spark.createDataFrame(rows, "key string, at int, is_open boolean"), spark.createDataFrame(told, "key string, at int, event string")
    got = {r.key: (r["count"], r.opened_at, r.resolved_at, r.notified_open, r.notified_resolved) for r in health.alert_lifecycle(s, t).collect()}
    assert got == {"a": (2, 5, None, False, False), "b": (1, 1, 3, True, True), "c": (0, None, None, False, False), "d": (2, 1, None, True, False)}
    assert {(r.key, r.event) for r in health.pending_notifications(health.alert_lifecycle(s, t)).collect()} == {("a", "opened")}
    assert {(r.key, r.event) for r in health.pending_notifications(health.alert_lifecycle(s)).collect()} == {("a", "opened"), ("d", "opened")}


def test_ingest_matches_and_is_idempotent(spark):
    from railbird.streaming.changes import ingest_changes

    races = spark.createDataFrame([(1, "GP", "2026-01-06", 1), (2, "GP", "2026-01-06", 2), (3, "GP", "2026-01-05", 1)], "race_id long, track_code string, race_date string, race_number int").withColumn("race_date", F.col("race_date").cast("date"))
    entries = spark.createDataFrame([(11, 1, "1", "Quick Fox"), (12, 1, "2", "Slow Dog"), (21, 2, "1", "Other One"), (31, 3, "1", "Quick Fox")], "entry_id long, race_id long, program_number string, horse_name string")
    feeds = [
        (1, "GP", "Race 1: # 1 Quick Fox Scratched - Vet<br/>Race 1: # 9 Nobody Here Scratched - Vet<br/>Race 7: Post Time changed to 1:30 PM"),
        (2, "GP", "Race 1: # 7 Slow Dog Jockey changed to A<br/>Race 2: Post Time changed to 1:30 PM"),
        (3, "GP", "Race 1: # 1 Quick Fox Scratched - Trainer<br/>Race 2: Post Time changed to 1:45 PM"),
    ]
    items = spark.createDataFrame(feeds, "doc_id long, track_code string, description string")
    none = spark.createDataFrame([], "race_id long, entry_id long, change_type string, description string")
    once = ingest_changes(none, items, races, entries, "2026-01-06")
    want = {(1, 11, "Scratch", "Scratched - Trainer"), (1, 12, "Jockey Change", "Jockey changed to A"), (2, None, "Post Time Change", "Post Time changed to 1:45 PM")}
    assert set(map(tuple, once.collect())) == want
    again = ingest_changes(once, items, races, entries, "2026-01-06")
    assert sorted(map(str, again.collect())) == sorted(map(str, once.collect()))


def test_rejected_bets_are_not_spent(spark):
    bets = spark.createDataFrame([(1, 1, 7, "Win", 900), (2, 1, 7, "Win", 200), (3, 1, 7, "Win", 50), (4, None, 7, "Win", 1), (5, 9, 7, "Win", 1), (6, 1, None, "Win", 1000), (7, 1, None, "Win", 1)], "bet_id int, race_id int, wallet_id int, bet_type string, bet_amount int")
    bets = bets.selectExpr("*", "cast(bet_id as timestamp) created_at", "cast(null as string) selection")
    got = {r.bet_id: r.reject_reason for r in betting.validate_bets(bets, spark.createDataFrame([(1,)], "race_id int")).collect()}
    assert got == {1: None, 2: "insufficient_funds", 3: None, 4: "missing_fields", 5: "race_not_found", 6: None, 7: "insufficient_funds"}


def test_a_place_of_zero_is_none(spark):
    money = "cast(4 as decimal(10,2))"
    entries = spark.createDataFrame([(1, "1", 0), (1, "2", 1), (1, "3", 2)], "race_id int, program_number string, finish_position int").selectExpr("*", "false scratched", f"{money} win_payout", f"{money} place_payout", f"{money} show_payout")
    bets = spark.createDataFrame([(1, "1", "Win", None), (2, "2", "Win", None), (3, "9", "Exacta Box", '["2","3"]'), (4, "1", "WPS", None)], "bet_id int, horse_number string, bet_type string, selection string").selectExpr("*", "1 race_id", "7 wallet_id", "cast(2 as decimal(10,2)) bet_amount", "'Pending' status", "now() created_at")
    races = spark.sql("SELECT 1 race_id, 'completed' race_status, DATE '2026-01-01' race_date")
    exotics = spark.sql("SELECT 1 race_id, 1 seq, '$2 Exacta' wager_type, cast(10 as decimal(10,2)) payout")
    got = {r.bet_id: (r.new_status, float(r.payout)) for r in betting.settle(bets, races, entries, exotics, "2026-01-05").collect()}
    assert got == {1: ("Loss", 0.0), 2: ("Win", 4.0), 3: ("Win", 10.0), 4: ("Loss", 0.0)}


def test_alert_opens_on_third_strike(spark):
    rows = [("results", i, s) for i, s in enumerate([True, True, False, True, True, True, True, False, True])]
    e = spark.createDataFrame(rows, "feed string, evaluated_at int, stale boolean")
    for size in (1, 3, 100):
        assert [(r.opened_at, r.resolved_at, r.severity) for r in health.stale_alerts(e, bucket=F.floor(F.col("evaluated_at") / size)).collect()] == [(5, 7, "critical")]


def test_freshness_rules(spark):
    rows = [(1, "results", "success", "2024-01-20 11:00:00"), (2, "results", "attempt", "2024-01-20 11:50:00"), (3, "scratches", "signal", "2024-01-20 11:55:00"), (4, "entries", "failure", "2024-01-20 11:59:00")]
    e = spark.createDataFrame(rows, "event_id int, feed string, kind string, at string").selectExpr("event_id", "feed", "kind", "timestamp(at) seen_at", "'rss' source")
    got = {r.feed: (r.stale, r.in_progress) for r in health.feed_freshness(e, EVENTS_AS_OF).collect()}
    assert got == {"results": (False, True), "scratches": (False, False), "entries": (True, False)}
    status = {r.feed: r.public_status for r in health.feed_public_status(health.feed_freshness(e, EVENTS_AS_OF)).collect()}
    assert status == {"results": "running", "scratches": "ok", "entries": "attention_needed"}
    life = health.alert_lifecycle(e.select(F.col("feed").alias("key"), F.col("seen_at").alias("at"), (F.col("kind") == "failure").alias("is_open")))
    assert life.where("key = 'entries'").first()["open"] and life.count() == 3


def test_apply_results_and_reset(spark):
    races = spark.createDataFrame([(1, "upcoming"), (2, "upcoming")], "race_id int, race_status string")
    entries = spark.createDataFrame([(10 * r + p, r, str(p), p == 2, None) for r in (1, 2) for p in (1, 2, 3, 4)], "entry_id int, race_id int, program_number string, scratched boolean, finish_position int")
    results = spark.createDataFrame([(1, "1", 2), (1, "2", 1), (1, "3", 3)], "race_id int, program_number string, finish_position int")
    r, e = changes.apply_results(races, entries, results)
    assert {x.race_id: x.race_status for x in r.collect()} == {1: "completed", 2: "upcoming"}
    assert {x.entry_id: (x.scratched, x.finish_position) for x in e.where("race_id = 1").collect()} == {11: (False, 2), 12: (False, 1), 13: (False, 3), 14: (True, None)}
    r, e, _ = changes.reset_races(r, e, spark.createDataFrame([(1,)], "race_id int"), races.where("race_id = 1"))
    assert r.where("race_status = 'completed'").isEmpty() and e.where("race_id = 1 AND (scratched OR finish_position IS NOT NULL)").isEmpty()


def test_settlement_pays_never_less_than_nothing(spark, sf):
    r = Racing(spark, sf)
    s = betting.settle(r.bets, r.races, r.entries, r.exotics, "1998-06-01")
    assert s.where("payout < 0 OR (new_status IN ('Loss', 'Pending') AND payout <> 0)").isEmpty()
    assert s.count() == r.bets.count()


def test_dedupe_is_idempotent_and_pages_cover_feed(spark, sf):
    from railbird.operators import dedupe, ordering
    from railbird.plans.products import _feed

    r = Racing(spark, sf)
    feed = dedupe.dedupe_changes(_feed(r, r.races)).cache()
    assert dedupe.dedupe_changes(feed).count() == feed.count()
    pages = [ordering.paginate(feed, ["race_date", "change_id", "source_rank"], p, 700)[0].count() for p in (1, 2, 3, 4)]
    assert sum(pages) == min(feed.count(), 2800)
