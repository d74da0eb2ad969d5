"""Queries that extract rows from pages.

Spark makes the pages of the racing tables in the layouts that landed pages have: with classes and
columns that say nothing, tables inside tables, broken lines and pages of another day; the twins read the tables themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from railbird.operators import extract, forms
from railbird.plans.catalog import _d, query
from railbird.plans.catalog_more import _joined


def _cat(*parts: str | Column) -> Column:
    """Texts joined; a plain string is itself, a column given by name stands in braces."""
    return F.concat(*(x if isinstance(x, Column) else F.col(x[1:-1]).cast("string") if x[:1] == "{" and x[-1:] == "}" else F.lit(x) for x in parts))


def _card(r, *more: str) -> DataFrame:
    """Entries with their race, horse, and the id of their card (track and day)."""
    races = r.races.select("race_id", "track_code", "race_date", "race_number", "is_cancelled", *more)
    return r.entries.join(races, "race_id").join(r.horses, "horse_id").withColumn("doc_id", _cat("{track_code}", "-", "{race_date}"))


_CARD = "SELECT e.*, r.track_code, r.race_date, cast(r.race_number as int) AS race_no, r.is_cancelled, h.horse_name, r.track_code || '-' || r.race_date AS doc_id FROM v_entries e JOIN v_races r ON r.race_id = e.race_id JOIN v_horses h ON h.horse_id = e.horse_id"
_PLAIN = "lower(regexp_replace(horse_name, '[^A-Za-z0-9]', '', 'g'))"


RACES_OF_PAGE = 50


def _paged(cards: DataFrame) -> DataFrame:
    """A card goes on on another page after some races, as cards of any length do: the place of the page after the card's id."""
    return cards.withColumn("doc_id", _cat("{doc_id}", "/", F.floor((F.col("race_number") - 1) / RACES_OF_PAGE).cast("string")))


def _unpaged() -> Column:
    return F.split_part("doc_id", F.lit("/"), F.lit(1)).alias("doc_id")


def _races_of(cards: DataFrame, row: Column, head: Column, tail: Column, by: str = "", turns: bool = False) -> DataFrame:
    """(doc_id, track_code, race_date, body): a page's races in order, each ``head``, its entries' ``row`` and ``tail``.

    With ``turns`` cards go on on other pages by the turn of their races, as ``_paged`` has it; races are numbered where the card's pages are made.
    """
    cards = cards.select("doc_id", "track_code", "race_date", "race_id", "race_number", "is_cancelled", "entry_id", row.alias("row"))
    races = cards.groupBy("doc_id", "track_code", "race_date", "race_id", "race_number", "is_cancelled").agg(F.sort_array(F.collect_list(F.struct("entry_id", "row"))).alias("rows"))
    told = races.withColumn("text", F.concat(head, F.array_join(F.transform("rows", lambda x: x["row"]), by), tail)).drop("rows")
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("race_number", "text"))), lambda x: x["text"]), by).alias("body")
    if not turns:
        return told.groupBy("doc_id", "track_code", "race_date").agg(body)
    turn = F.dense_rank().over(Window.partitionBy("doc_id").orderBy("race_number"))
    page = F.floor((turn - 1) / RACES_OF_PAGE).cast("string")
    pages = told.withColumn("page", page).groupBy("doc_id", "page", "track_code", "race_date").agg(body)
    return pages.withColumn("doc_id", _cat("{doc_id}", "/", "{page}")).drop("page")


_SAID = "CASE WHEN scratched THEN 'Scratched - Vet ' || entry_id % 7 ELSE 'Jockey changed to Rider ' || jockey_id END"


def _said() -> Column:
    return F.when(F.col("scratched"), F.concat(F.lit("Scratched - Vet "), (F.col("entry_id") % 7).cast("string"))).otherwise(_cat("Jockey changed to Rider ", "{jockey_id}"))


@query("v_entries", "v_races", "v_horses", sql=f"""
  , c AS ({_CARD}), k AS (SELECT * FROM c WHERE month(race_date) <> 3)
  SELECT doc_id, race_no AS race_number, CASE WHEN entry_id % 3 < 2 THEN program_number END AS program_number, {_PLAIN} AS horse_name,
         CASE WHEN scratched THEN 'Scratch' ELSE 'Jockey Change' END AS change_type, {_SAID} AS description FROM k
  UNION ALL SELECT DISTINCT doc_id, race_no, NULL, '', 'Race Cancelled', CASE WHEN race_id % 2 = 0 THEN 'Race Cancelled - Weather' ELSE 'Race: ' || race_no || ' Cancelled' END FROM k WHERE is_cancelled""")
def extract_html_changes(r):
    """A third of the horses in one cell, in two cells, and without a number; cards of March are of another day."""
    e = F.col("entry_id") % 3
    horse = F.when(e == 0, _cat('<td class="horse">#', "{program_number}", " ", "{horse_name}", "</td>")).when(
        e == 1, _cat("<td class='horse num'>#0", "{program_number}", "</td><td class='horse'><b>", "{horse_name}", "</b></td>")).otherwise(_cat("<td class=horse>", "{horse_name}", "</td>"))
    said = F.when(F.col("scratched"), F.concat(F.lit("<i>Scratched</i> - Vet "), (F.col("entry_id") % 7).cast("string"))).otherwise(_cat("Jockey changed&nbsp;to Rider ", "{jockey_id}", "; Jockey changed to Rider ", "{jockey_id}"))
    row = F.concat(F.lit("<tr>"), horse, F.lit('<td class="changes">'), said, F.lit('</td><td class="time">10:01 AM</td></tr>'))
    even = F.col("race_id") % 2 == 0
    head = _cat('<tr class="group-header"><th class="race">Race: ', "{race_number}", F.when(F.col("is_cancelled") & ~even, " Cancelled").otherwise(""), '</th><th class="changes">Changes</th><th>Time</th></tr>')
    tail = F.when(F.col("is_cancelled") & even, '<tr><td colspan="2">Race Cancelled - Weather</td><td></td></tr>'.replace("<td></td>", "")).otherwise("<tr><td>Exacta Wagering Cancelled</td></tr>")
    own = F.when(F.month("race_date") == 3, F.date_add("race_date", 1)).otherwise(F.col("race_date"))
    html = F.concat(F.lit("<h3>Late notes of "), F.date_format(own, "MMM d, yyyy"), F.lit("</h3><table><tr><td>menu</td><td><table>"), F.col("body"), F.lit('</table></td></tr></table><table><tr><th class="race">Race: 99</th></tr></table>'))
    pages = _races_of(_paged(_card(r)), row, head, tail).select("doc_id", "track_code", "race_date", html.alias("html"))
    return extract.extract_html_changes(pages, F.col("race_date")).select(_unpaged(), "race_number", "program_number", "horse_name", "change_type", "description")


@query("v_entries", "v_races", "v_horses", sql=f"""
  , c AS ({_CARD})
  SELECT doc_id, race_no AS race_number, program_number, {_PLAIN} AS horse_name, CASE WHEN scratched THEN 'Scratch' ELSE 'Jockey Change' END AS change_type, {_SAID} AS description FROM c
  UNION ALL SELECT DISTINCT doc_id, race_no, NULL, '', 'Other', 'Rail set at ' || race_no || ' ft.' FROM c""")
def extract_mobile_changes(r):
    said = F.when(F.col("scratched"), F.concat(F.lit("<i>Scratched</i> - Vet "), (F.col("entry_id") % 7).cast("string"))).otherwise(_said())
    row = _cat("<p><b># ", "{program_number}", " ", "{horse_name}", ":</b></p>\n<p><ChangeDescWeb>", said, "</ChangeDescWeb></p><p>10:01 AM ET</p>\n")
    head = _cat('<table width="100%" bgcolor="#008000"><tr><td><font color="#ffffff"><b>Race ', "{race_number}", "</b></font></td></tr></table>")
    tail = _cat("<p><ChangeDescWeb>Rail set at ", "{race_number}", " ft.</ChangeDescWeb></p><p>Reported at Entry Time</p>")
    html = F.concat(F.lit("<div>TODAY'S SCRATCHES AND CHANGES</div>"), F.col("body"))
    pages = _races_of(_paged(_card(r)), row, head, tail).select("doc_id", "track_code", html.alias("html"))
    return extract.extract_mobile_changes(pages).select(_unpaged(), "race_number", "program_number", "horse_name", "change_type", "description")


@query("v_entries", "v_races", "v_horses", sql=f"""
  , c AS ({_CARD} WHERE scratched), k AS (SELECT *, cast(race_date as varchar) AS day, 'Course ' || track_code AS track FROM c WHERE month(race_date) <> 3)
  SELECT day AS doc_id, track AS track_name, race_no AS race_number, program_number, horse_name, 'Scratch' AS change_type, 'Scratched' AS description FROM k
  UNION ALL SELECT day, track, race_no, program_number, horse_name, 'Other', 'Reason - Vet ' || entry_id % 7 FROM k WHERE entry_id % 2 = 0
  UNION ALL SELECT DISTINCT day, track, race_no, NULL, NULL, 'Other', 'Course condition ' || race_no FROM k""")
def extract_otb_changes(r):
    """Pages of a day with all its tracks; a horse's reason is a row of its own, a note before any horse is nobody's; pages of March bear another date."""
    reason = F.when(F.col("entry_id") % 2 == 0, F.concat(F.lit("<tr><td>&nbsp;</td><td>Reason - Vet "), (F.col("entry_id") % 7).cast("string"), F.lit("</td><td>10:02</td></tr>"))).otherwise("")
    row = F.concat(_cat("<tr><td>#", "{program_number}", "</td><td>", "{horse_name}", "</td><td>Scratched</td><td>10:01</td></tr>"), reason)
    head = _cat("<tr><td colspan=4>Course ", "{track_code}", " : Changes : Race ", "{race_number}", "</td></tr><tr><td></td><td>Course condition ", "{race_number}", "</td><td>9:00</td></tr>")
    cards = _races_of(_paged(_card(r).where("scratched")), row, head, F.lit("<tr><td>short</td><td>row</td></tr>"))
    page = F.split_part("doc_id", F.lit("/"), F.lit(2)).alias("page")
    days = _joined(cards.select("race_date", page, "track_code", "body"), ["race_date", "page"], ["track_code"], F.col("body"), "")
    own = F.date_format(F.when(F.month("race_date") == 3, F.date_add("race_date", 1)).otherwise(F.col("race_date")), "MM/dd/yyyy")
    html = F.concat(F.lit("<table><tr><td>menu</td></tr></table><table><tr><td colspan=4>Race Date: "), own, F.lit("</td></tr>"), F.col("text"), F.lit("</table>"))
    pages = days.select(_cat("{race_date}", "/", "{page}").alias("doc_id"), "race_date", html.alias("html"))
    return extract.extract_otb_changes(pages, F.col("race_date")).select(_unpaged(), "track_name", "race_number", "program_number", "horse_name", "change_type", "description")


@query("v_entries", "v_races", "v_horses", "v_jockeys", sql=f"""
  , c AS ({_CARD})
  SELECT doc_id, cast(dense_rank() OVER (PARTITION BY doc_id ORDER BY race_no) as int) AS race_number, program_number, horse_name, 'Trainer ' || trainer_id AS trainer_name, CASE WHEN entry_id % 7 > 0 THEN jockey_name END AS jockey_name, (entry_id % 30 + 1) || '/1' AS odds FROM c JOIN v_jockeys USING (jockey_id)""")
def extract_entry_tables(r):
    """A table per race; names in an h4 above the sire, in a link with a figure, or plain; some numbers stand under PP alone, some cells have no jockey."""
    e = F.col("entry_id")
    number = F.when(e % 5 == 0, _cat("<td></td><td>", "{program_number}", "</td>")).otherwise(_cat("<td>", "{program_number}", "</td><td>77</td>"))
    name = F.when(e % 3 == 0, _cat("<h4>", "{horse_name}", " </h4><p>Some Sire</p>")).when(e % 3 == 1, _cat('<a href="x">', "{horse_name}", " (97)</a> by Some Sire")).otherwise(_cat("{horse_name}", "<br>Some Sire"))
    people = F.concat(_cat("<p>Trainer ", "{trainer_id}", "</p>"), F.when(e % 7 == 0, "").otherwise(_cat("<p>", "{jockey_name}", "</p>")))
    row = F.concat(F.lit("<tr>"), number, F.lit('<td data-label="Horse / Sire">'), name, F.lit("</td><td>"), people, F.lit("</td><td>"), (e % 30 + 1).cast("string"), F.lit("/1</td></tr>"))
    picks = "<table><tr><th>Power Picks</th><th>Horse</th></tr><tr><td>1</td><td>No Card</td></tr></table>"
    head = F.lit(picks + "<div>Post time: 1:10 PM</div><table><tr><th>#</th><th>PP</th><th>Horse</th><th>Trainer / Jockey</th><th>ML</th></tr>")
    pages = _races_of(_card(r).join(r.jockeys, "jockey_id"), row, head, F.lit("</table>"), turns=True).select("doc_id", F.col("body").alias("html"))
    before = F.split_part("doc_id", F.lit("/"), F.lit(2)).cast("int") * RACES_OF_PAGE
    return extract.extract_entry_tables(pages).select(_unpaged(), (before + F.col("race_number")).alias("race_number"), "program_number", "horse_name", "trainer_name", "jockey_name", "odds")


@query("v_entries", "v_races", "v_horses", "v_jockeys", sql=f"""
  , c AS ({_CARD}), k AS (SELECT c.*, r.race_type, r.purse, r.surface, r.post_time, CASE WHEN r.distance <> '6F' THEN r.distance END AS distance, c.race_id % 2 = 0 AS listed FROM c JOIN v_races r USING (race_id))
  SELECT doc_id, race_no AS race_number, CASE WHEN scratched AND NOT listed THEN program_number || ' SCR' ELSE program_number END AS program_number, horse_name, jockey_name, 'Trainer ' || trainer_id AS trainer_name,
         CASE WHEN scratched AND NOT listed THEN 'SCR' ELSE (entry_id % 30 + 1) || '/2' END AS odds, scratched AND NOT listed AS scratched, race_type, substr(post_time, 1, 5) || ' PM' AS post_time, distance,
         CASE WHEN race_no % 3 = 0 THEN 'Dirt' ELSE surface END AS surface, purse
  FROM k JOIN v_jockeys USING (jockey_id)""")
def extract_static_entries(r):
    """Blocks of a row per horse, or of a table; every third names no surface."""
    odds = F.concat((F.col("entry_id") % 30 + 1).cast("string"), F.lit("/2"))
    out = F.when(F.col("scratched"), " SCR").otherwise("")
    row = F.concat(
        _cat('<div class="row no-gutters"><div class="col-1"><div class="saddlecloth-', "{program_number}", '">', "{program_number}"), out, _cat('</div></div><div class="col"><h4><b><a href="h">', "{horse_name}", " (97)</a></b></h4>"),
        _cat('<div>Jockey: <a href="j">', "{jockey_name}", '</a></div><div><i>Trainer:</i> <a href="t">Trainer ', "{trainer_id}", "</a></div><div>M/L Odds: "), odds, F.lit("</div></div></div>"),
    )
    line = F.concat(
        _cat('<tr><td><div class="paddingSaddleCloths">', "{program_number}", '</div></td><td><a href="x?type=Horse&amp;n=1">', "{horse_name}", ' (IRE)</a></td><td><a href="x?searchType=J">', "{jockey_name}", "</a></td>"),
        _cat('<td><a href="x?searchType=T">Trainer ', "{trainer_id}", "</a></td><td>"), odds, F.lit("</td></tr>"),
    )
    listed = F.col("race_id") % 2 == 0
    told = r.races.select("race_id", "race_type", F.concat(
        F.coalesce(F.concat(F.substring("post_time", 1, 5), F.lit(" PM ET | ")), F.lit("")), F.col("distance"), F.lit(" | . | "), F.when(F.col("race_number") % 3 == 0, "3yo").otherwise(F.col("surface")), F.lit(" | "), F.col("purse")
    ).alias("told"))
    info = told.select("race_id", _cat('<div class="race-info"><h3>', "{race_type}", "</h3><h5>", "{told}", "</h5></div>").alias("info"))
    e = _paged(_card(r)).join(r.jockeys, "jockey_id").select("doc_id", "race_id", "race_number", "entry_id", F.when(listed, line).otherwise(row).alias("row"))
    races = e.groupBy("doc_id", "race_id", "race_number").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("entry_id", "row"))), lambda x: x["row"]), "").alias("rows")).join(info, "race_id")
    body = F.when(listed, F.concat(F.lit('<table class="saddlecloths">'), F.col("rows"), F.lit("</table>"))).otherwise(F.concat(F.lit('<div class="content"><div class="contenders">'), F.col("rows"), F.lit("</div></div>")))
    pages = _joined(races, "doc_id", ["race_number"], F.concat(_cat('<div id="Race', "{race_number}", '" class="race">', "{info}"), body, F.lit("</div>")), "").withColumnRenamed("text", "html")
    return extract.extract_static_entries(pages).drop("line_no").withColumn("doc_id", F.split_part("doc_id", F.lit("/"), F.lit(1)))


@query("v_races", sql="""
  , s AS (SELECT track_code, min(race_date) AS a, max(race_date) AS b FROM v_races GROUP BY 1)
  SELECT track_code, a AS start_date, b AS end_date FROM s UNION ALL SELECT track_code, cast(b + INTERVAL 7 DAY as date), cast(b + INTERVAL 70 DAY as date) FROM s""")
def extract_race_schedule(r):
    spans = r.races.groupBy("track_code").agg(F.min("race_date").alias("a"), F.max("race_date").alias("b"))
    span = lambda a, b: F.concat(F.lit("<li>"), F.date_format(a, "MM/dd/yyyy"), F.lit(" - "), F.date_format(b, "MM/dd/yyyy"), F.lit(" (TB)</li>"))
    row = F.concat(_cat("<tr><td>COURSE ", "{track_code}", "</td><td>", F.lower("track_code"), "</td><td><ul>"), span("a", "b"), span(F.date_add("b", 7), F.date_add("b", 70)), F.lit("</ul></td></tr>"))
    pages = _joined(spans.withColumn("doc_id", F.lit(1)), "doc_id", ["track_code"], row, "")
    html = F.concat(F.lit("<table><tr><td>NOWHERE</td><td>X1</td><td>none</td></tr><tr><td>LONG</td><td>TOOLONG</td><td>01/01/1998 - 01/02/1998</td></tr>"), F.col("text"), F.lit("</table>"))
    return extract.extract_race_schedule(pages.select("doc_id", html.alias("html"))).drop("doc_id")


# --- charts ----------------------------------------------------------------------------------


@query("v_races", sql="""
  SELECT race_id AS doc_id, cast(race_number as int) AS race_number, race_date, surface, distance AS distance, purse, CASE race_type WHEN 'Maiden' THEN 'Maiden' ELSE race_type END AS race_type,
         '1:' || lpad(cast(race_id % 60 as varchar), 2, '0') || '.20' AS final_time, '22.' || lpad(cast(race_id % 100 as varchar), 2, '0') || ', 45.90' AS fractions, 'Gulfstream Park' AS track_name FROM v_races""")
def extract_chart_metadata(r):
    pad = lambda n: F.lpad((F.col("race_id") % n).cast("string"), 2, "0")
    d = F.date_format("race_date", "MMMM d, yyyy")
    text = F.concat(
        F.lit("GULFSTREAM PARK - "), d, _cat(" - Race ", "{race_number}", "\n", F.upper("race_type"), " - Thoroughbred\nDistance: ", "{distance}", ". On The ", "{surface}", "\nPurse: ", "{purse}", "\nFinal Time: 1:"),
        pad(60), F.lit(".20\nFractional Times: 22."), pad(100), F.lit(" 45.90 x"),
    )
    docs = r.races.select(F.col("race_id").alias("doc_id"), F.lit(1).alias("segment"), text.alias("text"))
    return extract.extract_chart_metadata(docs).drop("segment")


@query("v_entries", "v_horses", sql="SELECT race_id AS doc_id, finish_position, program_number, horse_name FROM v_entries JOIN v_horses USING (horse_id) WHERE finish_position IS NOT NULL")
def extract_running_lines(r):
    """Lengths stand on lines of their own, some of them with a number and a word; numbers have zeros before them."""
    e = r.entries.where("finish_position IS NOT NULL").join(r.horses, "horse_id")
    row = _cat("0", "{program_number}", " ", "{horse_name}", " ", F.when(F.col("entry_id") % 2 == 0, "Head").otherwise("1 12"), "\n4 Head\n1 1/2 1\n")
    text = _joined(e, "race_id", ["finish_position"], row, "")
    docs = text.select(F.col("race_id").alias("doc_id"), F.lit(1).alias("segment"), F.concat(F.lit("7 Before Any 1 2\nPast Performance Running Line Preview\nPgm Horse Name Start Fin\n"), "text", F.lit("Trainers: x\n8 After All 1 2")).alias("text"))
    return extract.extract_running_lines(docs).select("doc_id", "finish_position", "program_number", "horse_name")


@query("v_entries", "v_horses", "v_jockeys", sql="""
  SELECT race_id AS doc_id, program_number, horse_name, jockey_name AS jockey, (entry_id % 40) || '.' || lpad(cast(entry_id % 100 as varchar), 2, '0') AS odds, finish_position
  FROM v_entries JOIN v_horses USING (horse_id) JOIN v_jockeys USING (jockey_id) WHERE finish_position IS NOT NULL""")
def extract_text_horses(r):
    e = r.entries.where("finish_position IS NOT NULL").join(r.horses, "horse_id").join(r.jockeys, "jockey_id")
    i = F.col("entry_id")
    odds = F.concat((i % 40).cast("string"), F.lit("."), F.lpad((i % 100).cast("string"), 2, "0"), F.when(F.col("finish_position") == 1, "*").otherwise(""))
    row = F.concat(F.when(i % 2 == 0, "---").otherwise("12Mar274GP2"), _cat(" ", "{program_number}", " ", "{horse_name}", "(", "{jockey_name}", ") 120 Lb 3 2Hd "), odds, F.lit(" led, weakened\nno runner"))
    text = _joined(e, "race_id", ["finish_position"], row)
    docs = text.select(F.col("race_id").alias("doc_id"), F.lit(1).alias("segment"), F.concat(F.lit("1Jan271GP1 9 Before(Any) 1.10 x\nLastRaced Pgm HorseName(Jockey) Wgt\n"), "text", F.lit("\nFractional Times: 22.1\n1Jan271GP1 9 After(All) 1.10 x")).alias("text"))
    return extract.extract_text_horses(docs).select("doc_id", "program_number", "horse_name", "jockey", "odds", "finish_position")


@query("v_exotics", sql="SELECT race_id AS doc_id, CASE seq WHEN 1 THEN 'Exacta' WHEN 2 THEN 'Trifecta' ELSE 'Superfecta' END AS wager_type, cast(payout as double) AS payout FROM v_exotics")
def extract_exotic_payouts(r):
    """All wagers of a race, with thousands."""
    kind = F.element_at(F.array(*map(F.lit, ("$2 Exacta 4-5", "$1 Trifecta 4-5-6", "$0.10 Superfecta 4-5-6-7"))), F.col("seq").cast("int"))
    text = _joined(r.exotics, "race_id", ["seq"], F.concat(kind, F.lit(" $"), F.format_number("payout", 2)), " ")
    docs = text.select(F.col("race_id").alias("doc_id"), F.lit(1).alias("segment"), F.concat(F.lit("Total WPS Pool: $1,000\n6 Bold 8.40 4.20 "), "text", F.lit("\n")).alias("text"))
    return extract.extract_exotic_payouts(docs).select("doc_id", "wager_type", _d("payout"))


@query("v_entries", "v_horses", sql="SELECT race_id AS doc_id, CASE WHEN entry_id % 2 = 0 THEN horse_name ELSE 'Corvette ' || horse_name END AS scratched_name, count(*) AS n FROM v_entries JOIN v_horses USING (horse_id) WHERE scratched GROUP BY 1, 2")
def extract_scratched_names(r):
    """Reasons in brackets; names that hold the words of reasons; a broken line."""
    name = F.concat(F.when(F.col("entry_id") % 2 == 0, "").otherwise("Corvette "), F.replace("horse_name", F.lit(" "), F.lit("\n")), F.when(F.col("entry_id") % 3 == 0, " (Vet)").when(F.col("entry_id") % 3 == 1, "(Trainer)").otherwise(""))
    text = _joined(r.entries.where("scratched").join(r.horses, "horse_id"), "race_id", ["entry_id"], name, "; ")
    docs = text.select(F.col("race_id").alias("doc_id"), F.lit(1).alias("segment"), F.concat(F.lit("Chart\nScratched Horse(s): "), "text", F.lit(", Ox Trainers: 1 - Nobody")).alias("text"))
    return extract.extract_scratched_names(docs).groupBy("doc_id", "scratched_name").agg(F.count("*").alias("n"))


# --- forms -----------------------------------------------------------------------------------

_FORM = "CASE WHEN ascii(track_code[2]) % 2 = 0 THEN 'Keeneland' ELSE 'Woodbine' END"


def _form_track() -> Column:
    return F.when(F.ascii(F.substring("track_code", 2, 1)) % 2 == 0, "Keeneland").otherwise("Woodbine")


def _form_pages(r) -> DataFrame:
    """(doc_id, page_no, text): a form per card.  Race 1 stands below the index; races have a header page with their odd
    entries, then a page with their even ones."""
    e = r.entries
    named = r.horses.select("horse_id", F.concat(F.upper(F.substring("horse_name", 1, 1)), F.substring("horse_name", 2, 100)).alias("first"))
    e, first = e.join(named, "horse_id"), F.col("first")
    row = F.concat(F.col("program_number"), F.lit("\n"), F.when(F.col("entry_id") % 3 == 0, _cat(first, " of one line\nLife 4 M 1 0\n")).otherwise(_cat(first, " B.g.4 (Feb) Life 4\nSire: Some One\n")))
    later = F.concat(F.col("program_number"), F.lit("\n"), first, F.lit(" b.f.3 Life 2 1\nhard held\n"))
    odd = F.col("entry_id") % 2 == 1
    track = _form_track()
    # What a page says of its race is joined to its entries' lines once they are together.
    texts = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(c, F.struct("entry_id", "text")))), lambda x: x["text"]), "")
    said = e.select("race_id", "entry_id", F.when(odd, row).otherwise(later).alias("text"))
    held = said.groupBy("race_id").agg(texts(odd).alias("own"), texts(~odd).alias("rest"))
    races = held.join(r.races.select("race_id", "race_date", "track_code", "race_number", "distance", "surface", "race_type", "purse"), "race_id").withColumn("doc_id", _cat("{track_code}", "-", "{race_date}"))
    head = F.concat(_cat("{race_number}", "\n", track, "\n", "{race_type}", "\n", F.initcap("distance"), " (", F.when(F.col("surface") == "Synthetic", "Tapeta").otherwise(F.col("surface")), "). Purse", "{purse}", "\nFor Three Years Old, ", "{race_id}", "\nPosttime:1:20ET Wagers\n"), F.col("own"))
    cover = F.when(F.col("race_number") == 1, F.concat(F.lit("Daily Form "), track, F.lit("("), F.date_format("race_date", "M/d/yyyy"), F.lit(")\nINDEXTOENTRIES\n>A> Some One,1\n12\nSaratoga runner Life 2\n"))).otherwise("")
    pages = F.array(F.struct((F.col("race_number") * 2).alias("page_no"), F.concat(cover, head).alias("text")), F.struct((F.col("race_number") * 2 + 1).alias("page_no"), F.concat(F.lit("Daily Form page\n"), F.col("rest")).alias("text")))
    return races.select("doc_id", "race_id", F.explode(pages).alias("p")).select("doc_id", "race_id", "p.*")


@query("v_entries", "v_races", "v_horses", sql=f"""
  , c AS ({_CARD}) SELECT doc_id, race_no AS race_number, program_number, upper(split_part(horse_name, ' ', 1)) AS horse_name FROM c""")
def assemble_form_races(r):
    return forms.assemble_form_races(_form_pages(r).drop("race_id"))


@query("v_entries", "v_races", "v_horses", sql=f"""
  , c AS ({_CARD}) SELECT doc_id, cast(race_no * 2 as int) AS page_no, program_number, upper(split_part(horse_name, ' ', 1)) AS horse_name FROM c WHERE entry_id % 2 = 1""")
def extract_embedded_horses(r):
    return forms.extract_embedded_horses(_form_pages(r).where("page_no % 2 = 0")).select("doc_id", F.col("page_no").cast("int").alias("page_no"), "program_number", "horse_name")


@query("v_entries", "v_races", "v_horses", sql=f"""
  , c AS ({_CARD}) SELECT doc_id, cast(race_no * 2 + 1 as int) AS page_no, program_number, upper(split_part(horse_name, ' ', 1)) AS horse_name FROM c WHERE entry_id % 2 = 0""")
def extract_form_horses(r):
    return forms.extract_form_horses(_form_pages(r).where("page_no % 2 = 1")).select("doc_id", F.col("page_no").cast("int").alias("page_no"), "program_number", "horse_name")


@query("v_entries", "v_races", "v_horses", sql="""
  SELECT track_code || '-' || race_date AS doc_id, cast(race_number as int) AS race_number, CASE race_id % 5 WHEN 1 THEN '8 Miles' WHEN 2 THEN '350 Yards' WHEN 3 THEN '1 Mile' WHEN 4 THEN '7 Furlongs' END AS distance,
         CASE race_id % 5 WHEN 1 THEN 42240 WHEN 2 THEN 1050 WHEN 3 THEN 5280 WHEN 4 THEN 4620 END AS distance_feet, surface, race_type, purse, '1:20' AS post_time, 'For Three Years Old, ' || race_id AS conditions
  FROM v_races WHERE race_id IN (SELECT race_id FROM v_entries)""")
def extract_form_race(r):
    """Distances as they are read: the number right before the unit ('1 1/8 Miles' is 8); '6F' is none."""
    pages = _form_pages(r)
    name = F.when(F.ascii(F.substring("doc_id", 2, 1)) % 2 == 0, "Keeneland").otherwise("Woodbine")
    return forms.extract_form_race(pages.withColumn("text", forms.trim_index_page(F.col("text"), name))).drop("page_no")


@query("v_races", sql=f"""SELECT race_id, CASE race_id % 4 WHEN 0 THEN '1' || chr(10) || {_FORM} || chr(10) || race_id WHEN 1 THEN 'Indexed Stock ran well' || chr(10) || '1' || chr(10) || {_FORM} WHEN 2 THEN '' ELSE race_id || '' END AS text FROM v_races""")
def trim_index_page(r):
    kind = F.col("race_id") % 4
    own = F.concat(F.lit("1\n"), _form_track(), F.lit("\n"), F.col("race_id").cast("string"))
    text = F.when(kind == 0, F.concat(F.lit("Form\nINDEX TO ENTRIES\n1\nSome One,1\n"), own)).when(kind == 1, F.concat(F.lit("Indexed Stock ran well\n1\n"), _form_track())).when(kind == 2, "Form\nINDEXTOENTRIES\n2\nSome One").otherwise(F.col("race_id").cast("string"))
    return r.races.select("race_id", forms.trim_index_page(text, _form_track()).alias("text"))


@query("v_races", sql="SELECT race_id AS doc_id, CASE race_id % 2 WHEN 0 THEN 'GP' ELSE 'WO' END AS track_code, race_date FROM v_races")
def extract_form_header(r):
    """The name before the index counts, not those of running lines; dates in figures and in words."""
    figures = F.col("race_id") % 3 == 0
    name = F.when(F.col("race_id") % 2 == 0, "GulfstreamPark").otherwise("Woodbine")
    day = F.when(figures, F.concat(F.lit("("), F.date_format("race_date", "M/d/yyyy"), F.lit(")"))).otherwise(F.concat(F.lit("\n"), F.upper(F.date_format("race_date", "EEEE, MMMM d, yyyy"))))
    first = F.concat(F.lit("Daily Form "), name, day, F.lit("\nINDEXTOENTRIES\nran at Gulfstream and Saratoga"))
    pages = r.races.select(F.col("race_id").alias("doc_id"), F.explode(F.array(F.struct(F.lit(1).alias("page_no"), first.alias("text")), F.struct(F.lit(2).alias("page_no"), F.lit("Aqueduct\nJanuary 1, 1990").alias("text")))).alias("p")).select("doc_id", "p.*")
    return forms.extract_form_header(pages)


@query("v_entries", "v_races", sql="""
  SELECT race_id AS doc_id, entry_id AS page_no, race_id % 3 > 0 AND entry_id % 2 = 0 AS is_entry_page FROM v_entries""")
def detect_form_entry_pages(r):
    horse = F.when(F.col("race_id") % 3 == 0, "BOLD BOY of no breeding").otherwise("BOLD BOY b.g.4 Sire: Some One")
    number = F.when(F.col("entry_id") % 2 == 0, F.col("program_number")).otherwise("Race one")
    pages = r.entries.select(F.col("race_id").alias("doc_id"), F.col("entry_id").alias("page_no"), F.concat(F.lit("Form\n "), number, F.lit(" \n"), horse, F.lit("\nLife 3 1")).alias("text"))
    return forms.detect_form_entry_pages(pages).select("doc_id", "page_no", "is_entry_page")


@query("v_races", sql="SELECT race_id AS doc_id, CASE WHEN race_id % 4 < 2 THEN cast(race_number as int) END AS race_number, CASE WHEN race_id % 4 < 2 THEN cast(race_id % 4 + race_id % 3 as int) END AS header_line FROM v_races")
def detect_form_race_pages(r):
    """The number comes after up to three lines; a number above a horse, or without a track, is none."""
    before = F.concat(F.repeat(F.lit("\n"), (F.col("race_id") % 3).cast("int")), F.when(F.col("race_id") % 4 == 1, "Form\n").otherwise(""))
    below = F.when(F.col("race_id") % 4 == 2, "Woodbine Life 3 1").when(F.col("race_id") % 4 == 3, "Somewhere").otherwise("MdSpWt\nWoodbine")
    pages = r.races.select(F.col("race_id").alias("doc_id"), F.lit(1).alias("page_no"), F.concat(before, _cat("{race_number}", "\n"), below, F.lit("\nClaiming\nx\ny")).alias("text"))
    return forms.detect_form_race_pages(pages).select("doc_id", "race_number", "header_line")


@query("v_entries", "v_jockeys", sql="""
  SELECT entry_id, CASE WHEN entry_id % 2 = 0 THEN 'Blinkers' END AS equipment, CASE WHEN entry_id % 3 = 0 THEN 'Lasix' END AS medication, CASE WHEN entry_id % 3 = 0 THEN cast(110 + entry_id % 20 as int) END AS weight, 'Ann B. Low' AS trainer_name FROM v_entries""")
def extract_form_entry_details(r):
    i = F.col("entry_id")
    text = F.concat(F.when(i % 4 == 0, "Blinkers ON. ").when(i % 2 == 0, "BlinkersON ").otherwise("Blinkers off. "), F.when(i % 3 == 0, "L").otherwise("W "), (i % 20 + 110).cast("string"), F.lit(" Tr: Ann B. Low (12 3 2)"))
    return forms.extract_form_entry_details(r.entries.select("entry_id", text.alias("text"))).select("entry_id", "equipment", "medication", "weight", "trainer_name")
