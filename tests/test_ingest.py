"""The store of late changes: days, versions, replays, failures between tables, files that land."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from railbird.streaming import ingest

DAYS = ("2027-02-03", "2027-02-04", "2027-02-05")


def tables(spark):
    races = [(10 * d + n, day, "CT", n, "completed" if n == 4 else "upcoming", "13:00:00", False, None) for d, day in enumerate(DAYS) for n in (1, 2, 3, 4)]
    entries = [(100 * r[0] + p, r[0], r[1], str(p), f"Horse {p} of {r[0]}", False, p if r[3] == 3 else None) for r in races for p in (1, 2, 3)]
    dated = lambda df: df.withColumn("race_date", F.col("race_date").cast("date"))
    return (
        dated(spark.createDataFrame(races, "race_id long, race_date string, track_code string, race_number int, race_status string, post_time string, is_cancelled boolean, cancellation_reason string")),
        dated(spark.createDataFrame(entries, "entry_id long, race_id long, race_date string, program_number string, horse_name string, scratched boolean, finish_position int")),
    )


FEED = [  # doc_id, day, hour, lines
    (1, 0, 8, "Race 1: # 2 Horse 2 of 1 Scratched - Reason Unavailable<br/>Race 2: Post Time changed to 1:30 PM<br/>Race 9: Post Time changed to 1:31 PM<br/>Race 1: # 8 Nobody Scratched - Lame"),
    (2, 1, 8, "Race 1: <i>Race Cancelled</i> - Fog<br/>Race 3: <i>Race Cancelled</i> - Fog<br/>Race 4: <i>Race Cancelled</i> - Heat<br/>Race 2: Post Time changed to soon"),
    (3, 0, 9, "Race 1: # 2 Horse 2 of 1 Scratched - Lame<br/>Race 2: <i>Race Cancelled</i> - Heat<br/>Race 1: # 9 Horse 3 of 1 Jockey changed to B. Stone"),
    (4, 2, 8, "Race 1: # 1 Horse 1 of 21 Weight 121"),
    (5, 0, 10, "Race 2: Post Time changed to 2:05 PM<br/>Race 1: # 9 Horse 3 of 1 Jockey changed to C. Low<br/>Race 1: # 7 Unknown First Start Since Reported as Gelding"),
    (6, 1, 10, "Race 4: Post Time changed to 3:05 PM<br/>Race 4: <i>Race Cancelled</i> - Late"),
]


def feed(spark, rows):
    said = [(i, "CT", text, f"Wed, {3 + d:02d} Feb 2027 {h:02d}:00:00 EST", DAYS[d]) for i, d, h, text in rows]
    return spark.createDataFrame(said, "doc_id long, track_code string, description string, published string, race_date string").withColumn("race_date", F.col("race_date").cast("date"))


def told(spark, folder):
    return {t: sorted(map(str, ingest.read_store(spark, folder, t).collect())) for t in ingest.TABLES}


def new_store(spark):
    folder = tempfile.mkdtemp(prefix="spark-")
    ingest.create_store(folder, *tables(spark))
    return folder


def batch_twin(spark, batches):
    races, entries = tables(spark)
    now = {"changes": spark.createDataFrame([], ingest.CHANGES), "entries": entries, "races": races}
    for rows in batches:
        now = {t: spark.createDataFrame(df.collect(), df.schema) for t, df in ingest.apply_items(feed(spark, rows), **now).items()}
    return {t: sorted(map(str, df.collect())) for t, df in now.items()}


def landed(spark, batches):
    path = tempfile.mkdtemp(prefix="spark-")
    for rows in batches:  # files are read in the order of their times
        feed(spark, rows).coalesce(1).write.mode("append").parquet(path)
    return path


def run(spark, path, folder, checkpoint):
    stream = spark.readStream.schema(feed(spark, FEED[:1]).schema).option("maxFilesPerTrigger", 1).parquet(path)
    ingest.stream_ingest(stream, folder, checkpoint, {"availableNow": True}).awaitTermination(600)


def test_three_days_in_one_stream(spark):
    folder, batches = new_store(spark), [FEED[:2], FEED[2:4], FEED[4:]]
    run(spark, landed(spark, batches), folder, tempfile.mkdtemp(prefix="spark-"))
    got = told(spark, folder)
    assert got == batch_twin(spark, batches) == batch_twin(spark, [FEED])
    races = {r.race_id: (r.race_status, r.post_time, r.is_cancelled, r.cancellation_reason) for r in ingest.read_store(spark, folder, "races").collect()}
    assert races[2] == ("delayed", "2:05 PM", True, "Heat") and races[11] == ("cancelled", "13:00:00", True, "Fog") and races[12] == ("delayed", "13:00:00", False, None)
    assert races[13] == ("upcoming", "13:00:00", True, "Fog")  # it has run
    assert races[14] == ("cancelled", "3:05 PM", True, "Late")  # completed, then delayed, then cancelled
    changes = {(r.race_id, r.entry_id, r.change_type): r.description for r in ingest.read_store(spark, folder, "changes").collect()}
    assert changes[1, 102, "Scratch"] == "Scratched - Lame" and changes[1, 103, "Jockey Change"] == "Jockey changed to B. Stone; Jockey changed to C. Low" and changes[1, None, "Other"].startswith("First Start")
    assert {r.entry_id for r in ingest.read_store(spark, folder, "entries").where("scratched").collect()} == {102}
    # Day 2 was touched once: two versions; and no day has more than two.
    left = {p: sorted(os.listdir(f"{folder}/races/{p}")) for p in os.listdir(f"{folder}/races") if p.startswith("race_date")}
    assert left["race_date=2027-02-05"] == ["v=0", "v=2"] and all(len(v) <= 2 for v in left.values())


def test_replays_and_new_checkpoints(spark):
    folder, batches = new_store(spark), [FEED[:3], FEED[3:]]
    path, checkpoint = landed(spark, batches), tempfile.mkdtemp(prefix="spark-")
    run(spark, path, folder, checkpoint)
    got = told(spark, folder)
    before = ingest._last_commit(spark, folder)
    ingest.apply_batch(feed(spark, FEED[3:]), folder, before[1], before[2])  # the same batch again
    assert told(spark, folder) == got and ingest._last_commit(spark, folder) == before
    run(spark, path, folder, tempfile.mkdtemp(prefix="spark-"))  # all of it again, over the old store
    again = told(spark, folder)
    assert again["changes"] == got["changes"] and again["entries"] == got["entries"] and ingest._last_commit(spark, folder)[0] == before[0] + 2


@pytest.mark.parametrize("fails", ingest.TABLES[1:])
def test_a_batch_that_fails_between_tables_ends_as_if_run_once(spark, monkeypatch, fails):
    folder = new_store(spark)
    ingest.apply_batch(feed(spark, FEED[:3]), folder, "s", 0)
    half, write = told(spark, folder), ingest._write_days

    def failing(df, at, table, version):
        if table == fails:
            raise RuntimeError("lost")
        write(df, at, table, version)

    monkeypatch.setattr(ingest, "_write_days", failing)
    with pytest.raises(RuntimeError, match="lost"):
        ingest.apply_batch(feed(spark, FEED[3:]), folder, "s", 1)
    assert told(spark, folder) == half  # nobody sees half a batch
    monkeypatch.setattr(ingest, "_write_days", write)
    # Another batch comes first, of fewer days: nothing of the failed one may show.
    ingest.apply_batch(feed(spark, FEED[3:4]), folder, "s", 1)
    ingest.apply_batch(feed(spark, FEED[4:]), folder, "s", 2)
    assert told(spark, folder) == batch_twin(spark, [FEED[:3], FEED[3:4], FEED[4:]])


def test_feed_files_that_land(spark):
    folder, path, checkpoint, archive = new_store(spark), tempfile.mkdtemp(prefix="spark-"), tempfile.mkdtemp(prefix="spark-"), tempfile.mkdtemp(prefix="spark-")

    def land(name, *items, end="</channel></rss>"):
        body = "".join(f"<item><title>x</title><description>{d}</description>{f'<pubDate>{p}</pubDate>' if p else ''}</item>" for d, p in items)
        with open(f"{path}/{name}", "w") as f:
            f.write(f'<?xml version="1.0"?><rss><channel><pubDate>Mon, 01 Feb 2027 00:00:00 EST</pubDate>{body}{end}')

    def go():
        ingest.stream_ingest(ingest.stream_rss_items(spark, path, archive), folder, checkpoint, {"availableNow": True}).awaitTermination(600)

    land("CT-USA.rss", ("Race 1: &lt;b&gt;# 2 Horse 2 of 1&lt;/b&gt; &lt;i&gt;Scratched&lt;/i&gt; - Lame &amp;amp; sore", "Wed, 03 Feb 2027 08:00:00 EST"), ("Race 1: Post Time changed to 1:30 PM", "Thu, 04 Feb 2027 23:30:00 EST"), ("Race 2: Post Time changed to 1:30 PM", "yesterday"))
    land("CT-2.rss", ("Race 3: Post Time changed to 1:30 PM", "Wed, 03 Feb 2027 08:00:00 EST"), end="")
    go()
    assert {(r.race_id, r.entry_id, r.change_type) for r in ingest.read_store(spark, folder, "changes").collect()} == {(1, 102, "Scratch"), (11, None, "Post Time Change")}
    bad = spark.read.parquet(f"{folder}/quarantine").collect()
    assert len(bad) == 1 and "Race 3" in bad[0].broken
    land("CT-3.rss", ("Race 2: &lt;i&gt;Race Cancelled&lt;/i&gt; - Fog", "Fri, 05 Feb 2027 08:00:00 EST"), ("<b>", "Fri, 05 Feb 2027 08:00:00 EST"))
    go()
    assert {(r.race_id, r.change_type) for r in ingest.read_store(spark, folder, "changes").collect()} == {(1, "Scratch"), (11, "Post Time Change"), (22, "Race Cancelled")}
    assert ingest.read_store(spark, folder, "races", ["2027-02-05"]).where("race_id = 22").first().race_status == "cancelled"
    assert spark.read.parquet(f"{folder}/quarantine").count() == 2


def test_a_batch_writes_ids_of_scratched_entries_and_not_the_entries(spark):
    folder = new_store(spark)
    for n, rows in enumerate((FEED[:2], FEED[2:4], FEED[4:], [(7, 0, 11, "Race 2: # 1 Horse 1 of 2 Scratched - Lame")])):
        ingest.apply_batch(feed(spark, rows), folder, "s", n)
    day = f"{folder}/entries/race_date=2027-02-03"
    assert sorted(os.listdir(day)) == ["v=0", "v=3", "v=4"]  # the first one has all entries and stays
    assert spark.read.parquet(f"{day}/v=4").columns == ["entry_id"] and {r.entry_id for r in spark.read.parquet(f"{day}/v=4").collect()} == {102, 201}
    assert {r.entry_id for r in ingest.read_store(spark, folder, "entries").where("scratched").collect()} == {102, 201}
    assert ingest.read_store(spark, folder, "entries").where("NOT scratched").count() == 34
    assert not os.path.exists(f"{folder}/_matched")
