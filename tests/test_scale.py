"""Work that is cut where a key or a table is large: wallets, pages, database scans, orders."""

import random
import tempfile
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from railbird.operators import betting, ordering
from railbird.sources import tables


def test_funds_functions_compose():
    rnd = random.Random(1)
    for _ in range(200):
        costs = [rnd.choice([1, 2, 3, 5, 8, 100, 250]) for _ in range(rnd.randrange(1, 40))]
        starts, left = np.zeros(1, np.int64), np.zeros(1, np.int64)
        for c in costs:
            starts, left = betting._spend(starts, left, c)
        for x in range(0, 400, 7):
            want = x
            for c in costs:
                want -= c if c <= want else 0
            i = int(np.searchsorted(starts, x, "right")) - 1
            assert left[i] + x - starts[i] == want


@pytest.mark.parametrize("hours", [1, 40])
def test_one_wallet_with_many_bets(spark, hours):
    rnd = random.Random(hours)
    rows = [(i, 1, rnd.choice([7, 7, 7, None, 8]), "Win", rnd.choice([1, 2, 3, 40, 700]), rnd.randrange(hours * 3600)) for i in range(1500)]
    bets = spark.createDataFrame(rows, "bet_id int, race_id int, wallet_id int, bet_type string, bet_amount int, t int").selectExpr("*", "cast(360000000L + t as timestamp) created_at", "cast(null as string) selection")
    want, left = {}, {}
    for i, _, w, _, cost, _ in sorted(rows, key=lambda r: (r[5], r[0])):
        now = left.get(w, 1000)
        want[i] = None if cost <= now else "insufficient_funds"
        left[w] = now - cost if cost <= now else now
    decided = betting.validate_bets(bets, spark.createDataFrame([(1,)], "race_id int"))
    assert {r.bet_id: r.reject_reason for r in decided.select("bet_id", "reject_reason").collect()} == want


def test_pages_read_only_the_files_that_hold_them(spark):
    path = tempfile.mkdtemp(prefix="spark-")
    feed = spark.range(20_000).select(F.pmod(F.xxhash64("id"), F.lit(500)).alias("k"), "id")
    ordering.write_pages(feed, ["k", F.desc("id")], path, 1500)
    every = [(r.k, r.id) for r in feed.orderBy("k", F.desc("id")).collect()]
    for page, limit in ((1, 50), (77, 50), (400, 50), (401, 50), (2, 4000)):
        rows, total, pages, more = ordering.read_page(spark, path, page, limit)
        assert [(r.k, r.id) for r in rows.collect()] == every[(page - 1) * limit : page * limit]
        assert (total, pages, more) == (20_000, 20_000 // limit, page < 20_000 // limit)
        files = rows.inputFiles()
        assert len({f.split("part=")[1].split("/")[0] for f in files if "part=" in f}) <= (1 if limit == 50 and page in (1, 400) else 2 if limit == 50 else 5)
    fences = spark.read.parquet(f"{path}/fences").orderBy("first").collect()
    assert sum(r.rows for r in fences) == 20_000 and all(a.first + a.rows == b.first for a, b in zip(fences, fences[1:], strict=False)) and len(fences) > 5
    none = tempfile.mkdtemp(prefix="spark-")
    ordering.write_pages(feed.where("false"), ["k", "id"], none)
    rows, *rest = ordering.read_page(spark, none, 1, 50)
    assert rows.columns == ["k", "id", "pos"] and rows.collect() == [] and rest == [0, 0, False]


def test_database_parts_are_even_in_spite_of_gaps(spark):
    url, options = f"jdbc:derby:memory:{uuid.uuid4().hex};create=true", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    keys = [i for i in range(3000)] + [10_000_000 + 1000 * i for i in range(3000)] + [10**12 + i for i in range(3000)]
    rows = spark.createDataFrame([(k, str(k)) for k in keys] + [(None, "none")], "K long, NAME string")
    rows.write.option("createTableColumnTypes", "NAME VARCHAR(40)").jdbc(url, "T", properties=options)
    got = tables.scan_all(spark, url, "T", "K", 8, **options)
    sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 8 and max(sizes) <= 2 * min(sizes)
    assert sorted(map(str, got.collect())) == sorted(map(str, rows.collect()))
    assert tables.scan_all(spark, url, "T", "K", 8, ("NAME",), **options).columns == ["NAME"]
    rows.where("false").write.option("createTableColumnTypes", "NAME VARCHAR(40)").jdbc(url, "EMPTY", properties=options)
    assert tables.scan_all(spark, url, "EMPTY", "K", 8, **options).count() == 0
    assert tables.key_ranges(spark.createDataFrame([(1,)] * 9, "k int"), "k", 4) == ["k <= 1 OR k IS NULL", "k > 1"]


@pytest.mark.parametrize("rows_per_range", [100, 100_000])
def test_numbers_do_not_depend_on_the_ranges(spark, rows_per_range):
    feed = spark.range(3000).select(F.pmod(F.xxhash64("id"), F.lit(50)).alias("k"), "id")
    got = [(r.k, r.id) for r in ordering.numbered(feed, ["k", "id"], rows_per_range).orderBy("pos").collect()]
    assert got == sorted((r.k, r.id) for r in feed.collect())
