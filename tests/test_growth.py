"""What must not grow faster than its input: broadcasts, lists in windows, texts worked out again; and numbers beyond two digits."""

import re
import tempfile
from types import SimpleNamespace

from pyspark.sql import functions as F

from railbird.functions import changes
from railbird.operators import betting, extract, forms, joins, markup, ordering
from railbird.plans import catalog, products


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_names_of_many_horses_are_not_broadcast(spark):
    horses = spark.range(600).select(F.col("id").alias("horse_id"), F.element_at(F.array(F.lit("Red Fox"), F.lit("Blue Fox")), (F.col("id") % 2 + 1).cast("int")).alias("horse_name"))
    asked = spark.createDataFrame([("red fox",), ("Fox",), ("e",), ("",), ("owl",)], "request string")
    got = joins.lookup_horse(asked, horses)
    assert "Broadcast" not in plan(got)
    assert {r.request: (r.outcome, r.matches) for r in got.collect()} == {"red fox": ("ambiguous", 300), "Fox": ("ambiguous", 600), "e": ("ambiguous", 600), "": ("ambiguous", 600), "owl": ("not_found", 0)}


def test_feed_lines_of_races_beyond_99(spark):
    races = spark.createDataFrame([(1, 7), (2, 450)], "race_id int, race_number int").withColumn("track_code", F.lit("T01"))
    told = spark.createDataFrame([(1, 1, None, None, "Scratch Reason changed"), (2, 2, None, None, "Scratch Reason changed")], "change_id int, race_id int, entry_id int, program_number string, description string")
    r = SimpleNamespace(races=races, changes=told, entries=spark.createDataFrame([], "entry_id int, horse_id int"), horses=spark.createDataFrame([], "horse_id int, horse_name string"))
    assert sorted((x.doc_id, x.race_number) for x in catalog.extract_rss_changes(r).collect()) == [(1, 7), (2, 450)]


def test_tags_are_not_shuffled_and_carry_no_list_of_signs(spark):
    page = "<table><tr><td>menu</td></tr></table><table>" + "<tr><td>Changes</td></tr>" * 50 + "</table><table><tr><td>Changes</td></tr></table>"
    rows = markup.table_rows(spark.createDataFrame([(1, page)], "doc_id int, html string"), marked="Changes")
    assert plan(rows).count("Exchange") == 1 and "_signs" not in plan(rows)
    assert rows.count() == 50


def test_a_form_page_is_cut_once(spark):
    pages = spark.createDataFrame([(1, 1, "Form\n3\nMdSpWt\nWoodbine\nx"), (1, 2, "1\nx"), (1, 3, None)], "doc_id int, page_no int, text string")
    found = forms.detect_form_race_pages(pages.withColumn("text", F.trim("text")))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("split(") <= 2
    assert sorted((r.page_no, r.race_number, r.header_line) for r in found.collect()) == [(1, 3, 1), (2, None, None), (3, None, None)]


def test_a_description_is_cut_once():
    assert str(changes.normalize_change_description(F.col("x"))).count("split(") == 1


def test_table_rows_come_from_one_pass_over_a_page(spark):
    """Unclosed and nested elements, closings without openings, signs outside of tables, references and comments; no window over tags."""
    page = "Changes</td><table><tr><td>menu</table><a href=x><TABLE><tr><th CLASS='race big'>R&amp;1<!--</th>--><td/>&#9679;&#55296;<td><h4>A <b>B</b></h4> c</tr></table></a><table><tr><td>x<th class=\"changes\"></table><strong>"
    pages = spark.createDataFrame([(1, page), (2, None), (3, "<td>Changes")], "doc_id int, html string")
    rows = markup.table_rows(pages)
    assert "Window" not in plan(rows)
    told = lambda df: [[(c["tag"], c["classes"], markup_plain(c["text"]), c["named"]) for c in r.cells] for r in df.orderBy("doc_id", "row_no").collect()]
    want = [[("td", "", "menu", None)], [("th", "race big", "R&1\u25cf?A B c", "R&1\u25cf?A B c"), ("td", "", "A B c", "A B")], [("td", "", "x", None), ("th", "changes", "", None)]]
    got = told(rows)
    assert got[0] == want[0] and got[2] == want[2] and got[1][0][:2] == want[1][0][:2] and got[1][1] == want[1][1]
    assert told(markup.table_rows(pages, th_class="changes")) == [[("td", "", "x", None), ("th", "changes", "", None)]]
    assert told(markup.table_rows(pages, marked="&1"))[0][1] == want[1][1]


def markup_plain(text):
    return " ".join(text.split())


def test_bets_look_their_race_up_once(spark):
    bets = spark.createDataFrame([(i, i % 3, 1, "Win", 30, i) for i in range(6)], "bet_id int, race_id int, wallet_id int, bet_type string, bet_amount int, t int").selectExpr("*", "cast(t as timestamp) created_at", "cast(null as string) selection")
    got = betting.validate_bets(bets, spark.createDataFrame([(1,), (2,)], "race_id int"), 70)
    assert plan(got).count("Join") == 2  # funds, and the decisions
    assert {r.bet_id: r.reject_reason for r in got.collect()} == {0: "race_not_found", 1: None, 2: None, 3: "race_not_found", 4: "insufficient_funds", 5: "insufficient_funds"}


def test_changes_without_an_entry_are_not_all_of_one_key(spark):
    changes = spark.range(400).selectExpr("id change_id", "1 race_id", "if(id < 4, id, null) entry_id", "cast(null as string) program_number", "'Other' change_type", "'x' description", "timestamp '2024-01-01' created_at")
    entries = spark.createDataFrame([(i, 1, str(i), i, i == 9) for i in range(10)], "entry_id long, race_id int, program_number string, horse_id int, scratched boolean")
    races = spark.createDataFrame([(1, "k", "T01", 3, "12:00:00")], "race_id int, race_key string, track_code string, race_number int, post_time string").withColumn("race_date", F.lit("2024-01-01").cast("date"))
    r = SimpleNamespace(changes=changes, entries=entries, races=races, horses=spark.createDataFrame([(i, f"h{i}") for i in range(9)], "horse_id int, horse_name string"), tracks=spark.createDataFrame([("T01", "T")], "track_code string, track_name string"))
    feed = products._feed(r, races)
    assert re.search(r"Join \[_deal#\d+L?\], \[_entry#\d+L?\], LeftOuter", plan(feed))
    got = {x.change_id: (x.program_number, x.horse_name) for x in feed.where("source_rank = 0").collect()}
    assert len(got) == 400 and got[3] == ("3", "h3") and got[4] == ("-", "Race-wide")
    assert [(x.program_number, x.horse_name) for x in feed.where("source_rank = 1").collect()] == [("9", "Race-wide")]


def test_no_task_sorts_all_rows_for_the_fences(spark):
    store, path = spark.sparkContext._jsc.sc().statusStore(), tempfile.mkdtemp(prefix="spark-")
    stages = lambda: spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None))
    before = {s.stageId() for s in stages()}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ordering.write_pages(spark.range(5000).select("id", F.pmod(F.xxhash64("id"), F.lit(100)).alias("k")), ["k", "id"], path, 1000)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert not [s.stageId() for s in stages() if s.stageId() not in before and s.numTasks() == 1 and s.shuffleReadRecords() > 1000]
    got = [r.id for r in ordering.read_page(spark, path, 3, 700)[0].collect()]
    assert got == [r.id for r in spark.read.parquet(f"{path}/rows").orderBy("k", "id").offset(1400).limit(700).collect()]


def test_cells_of_tables_are_shuffled_once(spark):
    """The largest table, at a tie the first one, and those of its width give or take one; documents of single rows give nothing."""
    rows = [(1, 2, 0, ["h", "h", "h"]), (1, 2, 1, ["1", "A", "j"]), (1, 1, 0, ["h", "h", "h"]), (1, 1, 7, ["2", "B", "k"]), (1, 3, 0, ["3", "C", "l", "m", "n"]), (1, 4, 4, ["4", "D", "l", "m"]), (2, 1, 0, ["5", "E", "o"]), (None, 1, 0, ["6", "F", "o"]), (None, 1, 1, ["6", "F", "o"])]
    got = extract.extract_table_horses(spark.createDataFrame(rows, "doc_id int, table_no int, row_no int, cells array<string>").repartition(3))
    assert plan(got).count("Exchange hashpartitioning") == 1
    assert sorted((r.doc_id, r.program_number, r.horse_name, r.finish_position) for r in got.collect()) == [(1, "1", "A", 3), (1, "2", "B", 1), (1, "4", "D", 4), (1, "H", "h", 2)]
