"""Pages are gone through once, in the tasks that hold them: no window, no shuffle, and what overlaps is told as before."""

from railbird.operators import extract
from railbird.plans import catalog_pages
from railbird.sources.views import Racing


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def one(spark, *row):
    return spark.createDataFrame([row], "doc_id int, html string")


def test_static_cards_need_no_window_over_tags(spark):
    """Unclosed and nested blocks, rows and links; texts cut by tags; lines beside contenders; lines of two cells."""
    page = (
        '<div class="contenders"><div class="row"><div class="saddlecloth">9</div>no race</div></div><div id="Race07"><div class="race-info"><h3>Maiden <b>Claiming</b></h3><h3>other</h3><h5>1:05&nbsp;PM ET | 7 Furlongs</h5><h5>Turf</h5></div>'
        '<div class="contenders"><div class="row"><div><div class="a saddlecloth-1">1<br>A</div></div><h4><a>Ivy <i>&amp; Oak</i></a> <a>second</a></h4><div>jockey<!-- x -->: <a>B. <b>Stone</b></a><a>x</a></div><div>Trainer: none</div><div>M/L Odds: 9-2</div></div>'
        '<div class="row">no cloth</div><table><tr><td><div class="paddingSaddleCloths">8</div><td>x</td><td>1/2</td></tr></table></div></div><div id="Race8"><tr><td><div class=paddingSaddleCloths> 3 scr</div></td><td><a href="?type=Horse">Tom (GB) (9)</a></td><td>7/2</td></tr>'
        '<tr><td><div class=paddingSaddleCloths>4</div></td><td>short</td></tr><div id="RaceX"></div></div><div id="Race9"><div class="contenders"></div></div>'
    )
    got = extract.extract_static_entries(one(spark, 1, page))
    assert "Window" not in plan(got) and "Exchange" not in plan(got)
    assert [tuple(r)[:2] + tuple(r)[3:] for r in got.orderBy("line_no").collect()] == [
        (1, 7, "1 A", "Ivy & Oak", "B. Stone", None, "9", False, "Maiden Claiming", "1:05 PM", "7 Furlongs", "Turf", None),
        (1, 8, "3 scr", "Tom", None, None, "SCR", True, None, None, None, "Dirt", None),
    ]
    assert extract.extract_static_entries(one(spark, 1, None)).count() == 0


def test_changes_carry_their_race_without_a_window(spark):
    """A th of class race that names none leaves the race as it is; rows before the first race are of none; a nested table's rows are rows of their own, and end what is read of the outer one."""
    page = (
        '<table><tr><td class="horse">#1 Early</td><td class="changes">Changes</td><td></td></tr><tr><th class="race">RACE 12</th></tr><tr><th class="race">Post</th></tr>'
        '<tr><td class="horse">#02 Ivy</td><td class="changes">Scratched - <b>Vet</b>; scratched - vet</td><td></td></tr><tr><th class="race">Race: 3 Cancelled</th></tr>'
        '<tr><td class="horse x">#</td><td class="horse">Oak</td><td class="changes">Weight 12</td></tr><tr><td><table><tr><td>Race Cancelled</td></tr></table></td></tr><tr><td>Race Cancelled</td></tr></table>'
    )
    got = extract.extract_html_changes(spark.createDataFrame([(1, "CT", page)], "doc_id int, track_code string, html string"))
    assert "Window" not in plan(got) and "Exchange" not in plan(got)
    assert [tuple(r)[3:] for r in got.orderBy("line_no").collect()] == [
        (12, "2", "ivy", "Scratch", "Scratched - Vet"), (3, None, "", "Race Cancelled", "Race: 3 Cancelled"), (3, None, "oak", "Weight Change", "Weight 12"), (3, None, "", "Race Cancelled", "Race Cancelled"),
    ]


def test_entries_know_their_headers_without_a_window(spark, sf):
    """Headers of a table count wherever they stand in it; tables of one such header are no cards; the last column of a kind counts."""
    page = (
        "<table><tr><th>Horse</th></tr><tr><td>a</td></tr></table><table><tr><td>7</td><td>8</td><td>Ivy (GB)<br>sire</td><td>Ann<br>B. Stone</td><td> 3/1 </td></tr><tr><th>Pgm #</th><th>PP</th><th>Horse</th><th>Jockey</th></tr>"
        "<tr><td></td><td> </td><td><strong>Oak</strong><a>no</a></td></tr></table><table><tr><th>Horse</th><th>#</th><th>Trainer</th><th>Jockey</th></tr><tr><td>Tom</td><td>4</td><td>x</td><td>Ann</td></tr></table>"
    )
    got = extract.extract_entry_tables(one(spark, 1, page))
    assert "Window" not in plan(got) and "Exchange" not in plan(got)
    assert [tuple(r)[1:2] + tuple(r)[3:] for r in got.orderBy("row_no").collect()] == [(1, "7", "Ivy", "Ann", "B. Stone", "3/1"), (1, "0", "Oak", None, None, None), (2, "4", "Tom", "Ann", None, None)]
    made = catalog_pages.extract_entry_tables(Racing(spark, sf))  # a card's races are numbered and its pages made in one place
    assert plan(made).count("Exchange hashpartitioning(doc_id") == 1
