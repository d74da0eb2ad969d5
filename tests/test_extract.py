"""Extraction from documents, on short literal texts."""

from pyspark.sql import functions as F

from railbird.operators import extract, forms, markup


def one(spark, schema, *row):
    return spark.createDataFrame([row], schema)


def rows(df, *columns, by=None):
    return [tuple(r) for r in df.orderBy(*(by or columns)).select(*columns).collect()]


def test_rss(spark):
    text = (
        "Race 03: <b># 7 Copper Kettle</b> <i>Scratched</i> - Lame<br/>Race 03: <b># 07 Copper Kettle</b> Scratch Reason - Lame changed to Bruised Foot<br />"
        "Race 04: <i>Race Cancelled</i> - Fog<br/>Race 08: <i>Exacta Wagering Cancelled</i><br/>Race 09: Post Time changed to 4:10 PM<br/>nothing<br/>Race 2: Race Cancelled - Exacta Wagering"
    )
    got = rows(extract.extract_rss_changes(one(spark, "doc_id int, track_code string, description string", 1, "CT", text)), "race_number", "program_number", "horse_name", "change_type", by=["line_no"])
    assert got == [(3, "7", "copperkettle", "Scratch"), (3, "7", "copperkettle", "Other"), (4, None, "", "Race Cancelled"), (8, None, "", "Wagering"), (9, None, "", "Post Time Change"), (2, None, "", "Wagering")]
    assert extract.extract_rss_changes(one(spark, "doc_id int, track_code string, description string", 1, "CT", None)).count() == 0


def test_html_changes(spark):
    """Classes decide, whatever stands around them; layout tables, times, one or two horse cells, rows that cancel."""
    page = """<html><body><p>Late notes, Feb 3, 2027</p><table class=layout><tr><td>menu</td><td>
      <table><tr class="group-header"><th class="race big">Race: 3</th><th class="changes">Changes</th><th>Time</th></tr>
      <tr><td class="horse">#4 Copper Kettle</td><td class="changes"><i>Scratched</i> - Lame</td><td class="time">9:01 AM</td></tr>
      <tr><td class=horse>#05</td><td class='horse name'>Ivy &amp; Oak</td><td class="changes">First Start Since Reported as Gelding - Y;  Jockey changed to B. Stone</td><td>9:02</td></tr>
      <tr><td class="horse">Plain Jane</td><td class="changes">Weight 121</td><td>9:03</td></tr>
      <tr><td class="horse">#6 Nobody</td><td class="changes"> </td><td>9:04</td></tr>
      <tr><td colspan=2>Race Cancelled - Fog</td></tr><tr><td>note</td><td>Exacta Wagering Cancelled</td></tr>
      <tr><th class="race">Race 4 - Race Cancelled</th></tr><tr><td>all</td><td class="changes">Cancelled - Heat</td><td>10:00</td></tr>
      <tr><td class="horse">#1 Late</td><td class="changes">Blinkers off<td>10:01</tr></table></td></tr></table>
      <table><tr><th class="race">Race 9</th></tr><tr><td class="horse">#1 Other Table</td><td class="changes">Scratched</td><td></td></tr></table></body></html>"""
    df = one(spark, "doc_id int, track_code string, html string", 1, "CT", page)
    got = rows(extract.extract_html_changes(df), "race_number", "program_number", "horse_name", "change_type", "description", by=["line_no"])
    assert got == [
        (3, "4", "copperkettle", "Scratch", "Scratched - Lame"), (3, "5", "ivyoak", "Jockey Change", "First Start Since Reported as Gelding; Jockey changed to B. Stone"), (3, None, "plainjane", "Weight Change", "Weight 121"),
        (3, None, "", "Race Cancelled", "Race Cancelled - Fog"), (4, None, "", "Race Cancelled", "Race 4 - Race Cancelled"), (4, None, "", "Race Cancelled", "Cancelled - Heat"), (4, "1", "late", "Equipment Change", "Blinkers off"),
    ]
    day = lambda d: F.lit(d).cast("date")
    assert extract.extract_html_changes(df, day("2027-02-03")).count() == 7 and extract.extract_html_changes(df, day("2027-02-04")).count() == 0
    undated = one(spark, "doc_id int, track_code string, html string", 1, "CT", page.replace("Feb 3, 2027", ""))
    assert extract.extract_html_changes(undated, day("2027-02-04")).count() == 7
    assert extract.extract_html_changes(one(spark, "doc_id int, track_code string, html string", 1, "CT", None)).count() == 0


def test_mobile_changes(spark):
    bar = '<table width="90%" bgcolor="#008000"><tr><td><font color=white><b>Race {}</b></font></td></tr></table>'
    page = (
        "<html><div>Today's Scratches and Changes</div>" + bar.format(5) + "<p><b># 03 Copper Kettle:</b></p>\n<p><ChangeDescWeb><i>Scratched</i> - Lame</ChangeDescWeb></p><p>8:15 AM ET</p>"
        "<p><ChangeDescWeb>Hedge moved to 20 ft.</ChangeDescWeb></p><p>Told before</p>" + bar.format(6) + "<p><b>#1A Ivy (GB):</b></p><p><ChangeDescWeb>Jockey changed to B. Stone</ChangeDescWeb></p><p><ChangeDescWeb> </ChangeDescWeb></p></html>"
    )
    got = rows(extract.extract_mobile_changes(one(spark, "doc_id int, track_code string, html string", 1, "CT", page)), "race_number", "program_number", "horse_name", "change_type", "description", by=["race_number", "item_no"])
    assert got == [(5, "3", "copperkettle", "Scratch", "Scratched - Lame"), (5, None, "", "Other", "Hedge moved to 20 ft."), (6, "1A", "ivy", "Jockey Change", "Jockey changed to B. Stone")]
    assert extract.extract_mobile_changes(one(spark, "doc_id int, track_code string, html string", 1, "CT", page.replace("Scratches and", "other"))).count() == 0


def test_otb_changes(spark):
    page = """<table><tr><td>other</td></tr></table><table><tr><td colspan=4>Race Date: 02/03/2027</td></tr>
      <tr><td colspan=4>Low Park : Changes : Race 2</td></tr><tr><td>#3</td><td>Copper Kettle</td><td>Scratched</td><td>8:00</td></tr><tr><td></td><td>Reason - Lame</td><td>8:01</td></tr>
      <tr><td>#4</td><td>Ivy</td><td>Jockey now<br>B. Stone</td><td>8:02</td></tr><tr><td>only</td><td>two</td></tr>
      <tr><td colspan=4>High Park : Changes : Race 11</td></tr><tr><td></td><td>Hedge moved</td><td>9:00</td></tr><tr><td>#1A</td><td>Tom</td><td>Scratched</td><td>9:01</td></tr></table>"""
    df = one(spark, "doc_id int, html string", 1, page)
    want = [
        ("Low Park", 2, "3", "Copper Kettle", "Scratch", "Scratched"), ("Low Park", 2, "3", "Copper Kettle", "Other", "Reason - Lame"), ("Low Park", 2, "4", "Ivy", "Jockey Change", "Jockey now B. Stone"),
        ("High Park", 11, None, None, "Other", "Hedge moved"), ("High Park", 11, "1A", "Tom", "Scratch", "Scratched"),
    ]
    for day, expected in ((None, want), (F.lit("2027-02-03").cast("date"), want), (F.lit("2027-02-04").cast("date"), [])):
        assert rows(extract.extract_otb_changes(df, day), "track_name", "race_number", "program_number", "horse_name", "change_type", "description", by=["line_no"]) == expected


def test_tags_that_do_not_match(spark):
    """Unclosed and stray tags, quotes that hold a '>', comments, scripts."""
    page = "<table><tr><td>a<td>b</tr></b></td><tr><td title='x > y'>c<!-- <td>no</td> --></td><td><script>'<td>'</script>&lt;d&#233;&nbsp;e</td></table><td>outside</td>"
    got = markup.table_rows(one(spark, "doc_id int, html string", 1, page)).orderBy("row_no").select(F.transform("cells", lambda c: markup.plain(c["text"])).alias("c")).collect()
    assert [r.c for r in got] == [["a", "b"], ["c", "<dé e"]]
    empty = spark.createDataFrame([(1, ""), (2, None), (3, "<<<>>> <"), (4, "x" * 3_000_000)], "doc_id int, html string")
    assert markup.table_rows(empty).count() == 0


def test_payouts(spark):
    text = "Total WPS Pool: $1,000\n6 Fast Boy 8.40 4.20 2.80 $2 Exacta 4-5 33.00\n1A Slow 5.00 3.10 $1 Trifecta 99.00\n4 Third 2.10\nPast Performance"
    docs = one(spark, "doc_id int, segment int, text string", 1, 1, text)
    got = [tuple(None if x is None else float(x) if i else x for i, x in enumerate(r)) for r in extract.extract_wps_payouts(docs).orderBy(F.desc_nulls_last("win"), F.desc_nulls_last("place")).select("program_number", "win", "place", "show").collect()]
    assert got == [("6", 8.4, 4.2, 2.8), ("1A", None, 5.0, 3.1), ("4", None, None, 2.1)]
    assert {r.wager_type: float(r.payout) for r in extract.extract_exotic_payouts(docs).collect()} == {"Exacta": 33.0, "Trifecta": 99.0}


def test_chart_parts(spark):
    text = (
        "GULFSTREAM PARK - April 6, 2026 - Race 4\nALLOWANCE - For Thoroughbreds\nDistance: Six Furlongs On The Dirt\nPurse: $44,000\nFinal Time: 1:10.55\nFractional Times: 22.41 45.90\n"
        "Past Performance Running Line Preview\nPgm Horse Name Start\n6 Fast Boy 1 2 3\nmore words\n2 Slow Girl 4 5\nTrainers: 6 - Smith, A; 2 - O'Neil, B\nOwners: x\n"
        "Scratched Horse(s): Gone Away (Vet), Ox\n\nClaimed Horse(s): Fast Boy New Trainer: Al Jones New Ow|ner: Big\nStable\nFootnotes\n"
    )
    docs = one(spark, "doc_id int, segment int, text string", 1, 1, text)
    meta = extract.extract_chart_metadata(docs).first()
    assert (meta.track_name, meta.race_number, str(meta.race_date), meta.surface, meta.purse, meta.final_time, meta.fractions) == ("Gulfstream Park", 4, "2026-04-06", "Dirt", "$44000", "1:10.55", "22.41, 45.90")
    assert rows(extract.extract_running_lines(docs), "finish_position", "program_number", "horse_name") == [(1, "6", "Fast Boy"), (2, "2", "Slow Girl")]
    assert rows(extract.extract_trainers(docs), "program_number", "trainer_name") == [("2", "O'Neil, B"), ("6", "Smith, A")]
    assert rows(extract.extract_scratched_names(docs), "scratched_name") == [("Gone Away",)]
    assert rows(extract.extract_claims(docs), "horse_name", "new_trainer_name", "new_owner_name") == [("Fast Boy", "Al Jones", "Big Stable")]


def test_running_lines_that_break(spark):
    text = "Past Performance Running Line Preview\nPgm Horse Name Start Fin\n6 Copper Kettle 1 12\n4 Head\n1 1/2 1\n02 O'Hara&Co. 3 2\n3\n5 & Sons 4 4\n1A Ivy-Oak Nose\nNeck\nOwners: 9 Nobody 1 2\n8 After 1 2"
    docs = one(spark, "doc_id int, segment int, text string", 1, 1, text)
    want = [(1, "6", "Copper Kettle"), (2, "2", "O'HaraCo"), (3, "1A", "Ivy-Oak")]
    assert rows(extract.extract_running_lines(docs), "finish_position", "program_number", "horse_name") == want
    assert rows(extract.extract_text_horses(docs), "finish_position", "program_number", "horse_name") == want
    raw = "8Jan271CT3 9 Early(Rider,A) 118 2.50 x\nLastRaced Pgm HorseName(Jockey) Wgt\nFractional Times before any\n8Jan271CT3 4 Copper Kettle(Stone,B) 120 Lb 1.85* led all the way\nno runner\n--- 7 Ivy(Low,C) 120 12.30 far back\nFinal Time 1:10\n8Jan271CT3 5 After(Low,C) 1 2.30 x"
    got = extract.extract_text_horses(one(spark, "doc_id int, segment int, text string", 1, 1, raw))
    assert rows(got, "finish_position", "program_number", "horse_name", "jockey", "odds") == [(1, "4", "Copper Kettle", "Stone,B", "1.85"), (2, "7", "Ivy", "Low,C", "12.30")]


def test_scratched_names_with_reasons_in_them(spark):
    text = "Chart\nScratched Horse(s): Corvette Lane (Vet), Trainer's Pet (Trainer); Bold\nSteward, Ox Trainers: 1 - A"
    got = rows(extract.extract_scratched_names(one(spark, "doc_id int, segment int, text string", 1, 1, text)), "scratched_name")
    assert got == [("Bold Steward",), ("Corvette Lane",), ("Trainer's Pet",)]


def test_entry_tables(spark):
    page = """<table><tr><th>Power Picks</th><th>Horse</th></tr><tr><td>1</td><td>No Card</td></tr></table>
      <table><tr><th>#</th><th>PP</th><th>Horse</th><th>Trainer / Jockey</th><th>ML</th></tr>
      <tr><td></td><td>2</td><td data-label="Horse / Sire"><h4>Copper <b>Kettle</b> </h4><p>Old Tin</p></td><td><p>Ann Low</p><p>B. Stone</p></td><td>20/1</td></tr>
      <tr><td>3</td><td>4</td><td><a href="x">Ivy (97)</a> by Oak</td><td>Cy High</td></tr><tr><td>5</td><td>6</td><td>Plain Jane (IRE)<br>her sire</td><td></td><td>3/1</td></tr></table>
      <table><tr><th>Horse</th><th>Jockey</th></tr><tr><td>x</td><td>y</td><td>Third</td></tr></table>"""
    got = rows(extract.extract_entry_tables(one(spark, "doc_id int, html string", 1, page)), "race_number", "program_number", "horse_name", "trainer_name", "jockey_name", "odds", by=["race_number", "row_no"])
    assert got == [(1, "2", "Copper Kettle", "Ann Low", "B. Stone", "20/1"), (1, "3", "Ivy", "Cy High", None, None), (1, "5", "Plain Jane", None, None, "3/1"), (2, "x", "x", "y", None, None)]


def test_static_entries(spark):
    row = '<div class="row"><div class="col saddlecloth-{0}">{0}</div><h4><b><a href="h">{1}</a></b></h4><div>Jockey: <a>B. {1}</a></div><div>Trainer: <a>Ann {1}</a></div><div>M/L Odds: {2}</div></div>'
    page = (
        '<div id="Race4" class="x"><div class="row race-info"><h3>Claiming</h3><h5>1:26 PM ET | . | 6 F | Turf | $12,500 | 3yo</h5></div><div class="content"><div class="contenders">'
        + row.format("1", "Copper Kettle (97)", "5/2") + row.format("2 SCR", "Ivy", "8") + '<div class="row"><h4>no cloth</h4></div></div></div></div>'
        '<div id="Race5"><div class="race-info"><h5>6 Furlongs</h5></div><table class="saddlecloth"><tr><td><div class="paddingSaddleCloths">7</div></td><td><a href="?type=Horse&amp;x">Plain (IRE) Jane</a></td>'
        '<td><a href="?searchType=J">C. Low</a></td><td><a href="?searchType=T">D. High</a></td><td>7/2</td></tr><tr><td>short</td></tr></table></div><div id="RaceX"></div>'
    )
    got = extract.extract_static_entries(one(spark, "doc_id int, html string", 1, page))
    assert rows(got, "race_number", "program_number", "horse_name", "jockey_name", "trainer_name", "odds", "scratched", by=["line_no"]) == [
        (4, "1", "Copper Kettle", "B. Copper Kettle (97)", "Ann Copper Kettle (97)", "5/2", False), (4, "2 SCR", "Ivy", "B. Ivy", "Ann Ivy", "SCR", True), (5, "7", "Plain Jane", "C. Low", "D. High", "7/2", False),
    ]
    assert rows(got, "race_number", "race_type", "post_time", "distance", "surface", "purse", by=["line_no"])[1:] == [(4, "Claiming", "1:26 PM", "6 F", "Turf", "$12500"), (5, None, None, "6 Furlongs", "Dirt", None)]


def test_schedule_and_links(spark):
    line = "<tr><td>{}</td><td>{}</td><td><ul>{}</ul></td></tr>"
    page = "<table>" + line.format("LOW PARK", "lp1", "<li>01/02/2027 - 04/10/2027 (TB)</li><li>09/01/2027 - 10/31/2027</li>") + line.format("HIGH", "HIGHS", "<li>01/02/2027 - 04/10/2027</li>") + line.format("X", "CT", "<li>02/30/2027 - 04/10/2027</li>") + "<tr><td>TB</td></tr></table>"
    got = [(r.track_code, str(r.start_date), str(r.end_date)) for r in extract.extract_race_schedule(one(spark, "doc_id int, html string", 1, page)).orderBy("start_date").collect()]
    assert got == [("LP1", "2027-01-02", "2027-04-10"), ("LP1", "2027-09-01", "2027-10-31")]
    page = '<a href="latechangesGP-USA.html">x</a><a href="other.html">'
    assert rows(extract.extract_change_links(one(spark, "page_id int, html string", 1, page)), "track_code") == [("GP",)]


def test_form_pages(spark):
    first = """Daily Form Keeneland(2/3/2027)
INDEXTOENTRIES
>A> CopperKettle,1 Ivy,1
1
Keeneland
Md20000
1MILE (Turf). Purse$21,500
For Maidens, Four Years Old
Posttime:12:50ET Wagers
1
CopperKettle B.g.4 (Feb) Life 4 M 1 0
Sire: Old Tin
Life 2 0 0
2
Ivy's Dr.m.5 (Mar)
Sire: Oak
3
"""
    pages = [
        ("k", 1, first), ("k", 2, "Daily Form\n1\nCopperKettle B.g.4 (Feb) Life\n2\nIndexed Stock of another kind\n04\nTail b.f.3\n25\nToo c.c.2 Life"),
        ("k", 3, "2\nKeeneland\nClaiming\n6Furlongs (Tapeta)\nPosttime:1:20ET\n9\nLate One\nnothing\n7\nBold b.g.3\nSire: x"),
        ("m", 1, "Daily Form Woodbine(2/4/2027)\n3\nEarly b.m.3 Life\nPost Time: 2:05 PM"), ("m", 2, "Indexed horses ran well"), ("m", 3, "Form\n2\nAqueduct\nHandicap\n"), ("n", 1, None), ("o", 1, "Form Saratoga(2/4/2027)\nINDEX TO ENTRIES\nall"),
    ]
    df = spark.createDataFrame(pages, "doc_id string, page_no int, text string")
    head = {r.doc_id: (r.track_code, str(r.race_date)) for r in forms.extract_form_header(df).collect()}
    assert head == {"k": ("KEE", "2027-02-03"), "m": ("WO", "2027-02-04"), "n": (None, "None"), "o": ("SAR", "2027-02-04")}
    trimmed = df.withColumn("text", forms.trim_index_page(F.col("text"), F.lit("Keeneland")))
    assert {(r.doc_id, r.page_no): r.text for r in trimmed.collect()} == {(d, p): {("k", 1): first[first.index("1\nKee") :], ("o", 1): ""}.get((d, p), t) for d, p, t in pages}
    heads = forms.detect_form_race_pages(trimmed).where("race_number IS NOT NULL")
    assert rows(heads, "doc_id", "page_no", "race_number", "header_line") == [("k", 1, 1, 0), ("k", 3, 2, 0), ("m", 3, 2, 1)]
    assert rows(forms.extract_form_race(trimmed), "doc_id", "page_no", "distance", "distance_feet", "surface", "race_type", "purse", "post_time", "conditions")[:2] == [
        ("k", 1, "1 Mile", 5280, "Turf", "Maiden", "$21,500", "12:50", "For Maidens, Four Years Old"), ("k", 3, "6 Furlongs", 3960, "Synthetic", "Claiming", None, "1:20", None),
    ]
    assert rows(forms.assemble_form_races(df), "doc_id", "race_number", "program_number", "horse_name") == [
        ("k", 1, "1", "COPPERKETTLE"), ("k", 1, "2", "IVY'S"), ("k", 1, "4", "TAIL"), ("k", 2, "7", "BOLD"), ("m", 1, "3", "EARLY"),
    ]


def test_form_details(spark):
    df = spark.createDataFrame([(1, "Blinkers ON L122 Tr: Ann B. Low (12 3 2)"), (2, "BLINKERSON Tr: Cy 2025: x"), (3, "Lasix L12 118 tr: no"), (4, None)], "entry_id int, text string")
    got = rows(forms.extract_form_entry_details(df), "entry_id", "equipment", "medication", "weight", "trainer_name")
    assert got == [(1, "Blinkers", "Lasix", 122, "Ann B. Low"), (2, "Blinkers", None, None, "Cy"), (3, None, None, None, None), (4, None, None, None, None)]


def test_page_segments(spark):
    from railbird.operators.dedupe import page_segments

    pages = spark.createDataFrame([(1, 1, "cover"), (1, 2, "Race 1"), (1, 3, "more"), (1, 4, "Race 2"), (2, 1, None)], "doc_id int, page_no int, text string")
    got = rows(page_segments(pages, F.col("text").startswith("Race")), "doc_id", "page_no", "segment")
    assert got == [(1, 1, 0), (1, 2, 1), (1, 3, 1), (1, 4, 2), (2, 1, 0)]
