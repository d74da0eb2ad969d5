"""Rows out of landed documents: feeds, change pages, charts, forms and schedules.

Every job is split, explode, extract, carry forward, filter, in native expressions; the
windows are within a document.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from railbird.functions import changes, names, racing, times
from railbird.operators.forms import (  # noqa: F401  forms are read by their own module
    _staged, assemble_form_races, detect_form_entry_pages, detect_form_race_pages, extract_embedded_horses, extract_form_entry_details, extract_form_header, extract_form_horses, extract_form_race, trim_index_page,
)
from railbird.operators.markup import card_blocks, change_rows, entry_rows, of_tag, page_rows, plain, table_rows, text_at

LINE_BREAK = r"<br\s*/?>"


def strip_tags(text: Column) -> Column:
    return names.squeeze(F.regexp_replace(F.regexp_replace(text, r"<[^>]+>", " "), "&nbsp;|&amp;", " "))


def _first(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(F.coalesce(text, F.lit("")), pattern, group), F.lit(""))


# How a feed's line goes on after a horse.
AFTER_HORSE = ("Scratched", "Scratch Reason", "Jockey", "Weight", "First Start", "Gelding", "Correction", "Equipment", "Workouts")


def lines(docs: DataFrame, text: str = "text", by: str = r"\r?\n", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """A row per line: keys, line_no from 0, line."""
    return docs.select(*keys, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), by)).alias("line_no", "line"))


def extract_rss_changes(items: DataFrame, keys: tuple[str, ...] = ("doc_id", "track_code")) -> DataFrame:
    """(doc_id, track_code, description) -> a row per feed line that names a race, with the item's ``keys``."""
    at = lines(items, "description", LINE_BREAK, keys).where("trim(line) <> ''")
    cancelled = r"(?is)Race\s*(\d+):.*?Race Cancelled.*?- (.*)"
    horse = rf"(?is)^#\s*(\w+)\s+(.*?)\s+((?:{'|'.join(AFTER_HORSE)}).*)"
    line = F.col("line")
    at = _staged(at, off=_first(line, cancelled), why=F.trim(F.regexp_extract(line, cancelled, 2)), plain=F.trim(F.regexp_replace(line, r"<[^>]+>", "")))
    at = _staged(at, race=F.coalesce("off", _first(F.col("plain"), r"^Race\s*(\d+):")).cast("int"), content=F.trim(F.regexp_replace("plain", r"^Race\s*\d+:", ""))).where("race IS NOT NULL")
    at = _staged(at, pgm=_first(F.col("content"), horse), horse=_first(F.col("content"), horse, 2), rest=F.coalesce(_first(F.col("content"), horse, 3), F.col("content")))
    real = changes.valid_cancellation(line) | changes.valid_cancellation(F.col("why"))
    is_off, rest = F.col("off").isNotNull(), F.col("rest")
    return at.select(
        *keys,
        "line_no",
        F.col("race").alias("race_number"),
        F.when(~is_off & F.col("pgm").isNotNull(), names.normalize_pgm(F.col("pgm"))).alias("program_number"),
        F.when(is_off, "").otherwise(names.normalize_name(F.col("horse"))).alias("horse_name"),
        F.when(is_off, F.when(real, "Race Cancelled").when(F.lower("why").contains("wagering"), "Wagering").otherwise("Other")).otherwise(changes.change_type_rss(rest)).alias("change_type"),
        F.when(is_off, F.col("why")).otherwise(changes.normalize_change_description(rest)).alias("description"),
    )


def stale_page(text: Column, day: Column) -> Column:
    """Whether a page is of another day: it names the day nowhere, and another one (Jan 5, 2026) in its first thousand characters."""
    own = F.lit(False)
    for form in ("MMMM dd, yyyy", "MMM dd, yyyy", "MM/dd/yyyy"):
        own = own | text.contains(F.date_format(day, form))
    other = F.transform(F.regexp_extract_all(F.substring(text, 1, 1000), F.lit(r"([A-Z][a-z]{2}\s+\d{1,2},\s+\d{4})"), F.lit(1)), lambda d: F.to_date(F.try_to_timestamp(F.regexp_replace(d, r"\s+", " "), F.lit("MMM d, yyyy"))))
    return F.coalesce(F.exists(other, lambda d: d != day) & ~own, F.lit(False))


def extract_html_changes(pages: DataFrame, day: Column | None = None) -> DataFrame:
    """(doc_id, track_code, html) of change tables -> a row per change.

    Read is the first table that speaks of Changes or has a th of class ``changes``.  A row with a th of class ``race``
    starts a race.  Changes are in the cell of class ``changes``, the horse in one cell of class ``horse`` ('#4 Name') or two; other
    cells say nothing.  A short row, a row without a horse, or a race's th can cancel the race.  With ``day`` pages of other days give nothing.
    """
    if day is not None:
        text = names.squeeze(F.regexp_replace("html", r"<[^>]+>", " "))
        pages = _staged(pages, _text=text).where(~stale_page(F.col("_text"), day)).drop("_text")
    columns = [("row_no", pa.int32()), ("race_number", pa.int32()), ("head", pa.string()), ("n", pa.int32()), ("horses", pa.int32()), *((n, pa.string()) for n in ("one", "two", "change")), ("short", pa.list_(pa.string()))]
    carried = page_rows(pages, ("doc_id", "track_code"), change_rows, columns)
    n, off = F.col("n"), F.get(F.filter("short", lambda t: changes.valid_cancellation(t)), F.lit(0))
    joint = r"^#?\s*(\S+)\s*(.*)$"
    numbered = F.col("one").contains("#")
    pgm = F.when(F.col("horses") >= 2, F.replace("one", F.lit("#"))).when(numbered, F.regexp_extract("one", joint, 1))
    name = F.when(F.col("horses") >= 2, F.col("two")).when(numbered, F.regexp_extract("one", joint, 2)).otherwise(F.col("one"))
    is_head = F.col("head").isNotNull()
    cancels = F.when(is_head, F.when(changes.valid_cancellation(F.col("head")), F.col("head"))).when(n <= 2, off).when((F.col("horses") == 0) & changes.valid_cancellation(F.col("change")), F.col("change"))
    carried = _staged(carried, cancels=cancels, pgm=F.nullif(F.trim(pgm), F.lit("")), name=name, said=changes.normalize_change_description(F.col("change")))
    is_off = F.col("cancels").isNotNull()
    named = ~is_head & (n >= 3) & (F.col("horses") > 0) & (F.col("said") != "")
    return carried.where(is_off | F.coalesce(named, F.lit(False))).select(
        "doc_id", "track_code", F.col("row_no").alias("line_no"), "race_number",
        F.when(~is_off & F.col("pgm").isNotNull(), names.normalize_pgm(F.col("pgm"))).alias("program_number"),
        F.when(is_off, "").otherwise(names.normalize_name(F.col("name"))).alias("horse_name"),
        F.when(is_off, "Race Cancelled").otherwise(changes.change_type(F.col("said"))).alias("change_type"), F.coalesce("cancels", "said").alias("description"),
    )


def extract_mobile_changes(pages: DataFrame) -> DataFrame:
    """(doc_id, track_code, html): below each race's green bar, notes in ChangeDescWeb, some after a paragraph '# n Name:'; pages without their heading give nothing."""
    told = pages.where(F.upper(strip_tags(F.coalesce("html", F.lit("")))).contains("TODAY'S SCRATCHES AND CHANGES"))
    bar = r'<table[^>]*bgcolor="#008000"[^>]*>.*?<b>Race\s+(\d+)</b>.*?</table>'
    blocks = lines(told, "html", rf"(?is)(?={bar})", ("doc_id", "track_code"))
    blocks = _staged(blocks, race=_first(F.col("line"), rf"(?is)^{bar}").cast("int"), block=F.regexp_replace("line", rf"(?is)^{bar}", "")).where("race IS NOT NULL")
    note = r"(?is)(?:<p>\s*<b>#\s*([^<:\s]+)\s+([^<]+?):\s*</b>\s*</p>\s*)?<p>\s*<ChangeDescWeb>\s*(.*?)\s*</ChangeDescWeb>\s*</p>"
    items = blocks.select("doc_id", "track_code", F.col("race").alias("race_number"), "line_no", F.posexplode(F.regexp_extract_all("block", F.lit(note), F.lit(0))).alias("item_no", "item"))
    items = _staged(items, pgm=_first(F.col("item"), note), horse=F.regexp_extract("item", note, 2), said=changes.normalize_change_description(strip_tags(F.regexp_extract("item", note, 3))))
    return items.where("said <> ''").select(
        "doc_id", "track_code", "race_number", "line_no", "item_no", F.when(F.col("pgm").isNotNull(), names.normalize_pgm(F.col("pgm"))).alias("program_number"),
        names.normalize_name(F.col("horse")).alias("horse_name"), changes.change_type(F.col("said")).alias("change_type"), F.col("said").alias("description"),
    )


def extract_otb_changes(pages: DataFrame, day: Column | None = None) -> DataFrame:
    """(doc_id, html) of a page of several tracks -> a row per change.

    In the first table with a 'Race Date:', a row 'Track: … Change …: Race n' starts a race and forgets the horse; four cells with a
    number ('#4') are a horse and its change, three cells are another change of the last horse.  With ``day`` pages of other days give nothing.
    """
    if day is not None:
        at = F.to_date(F.try_to_timestamp(F.regexp_extract(strip_tags(F.col("html")), r"Race Date:\s*(\d{1,2}/\d{1,2}/\d{4})", 1), F.lit("M/d/yyyy")))
        pages = pages.where(F.coalesce(at == day, F.lit(False)))
    rows = table_rows(pages, ("doc_id",), marked="Race Date:")
    whole = F.array_join(F.transform("cells", lambda c: plain(c["text"])), "")
    rows = _staged(rows, tds=of_tag(F.col("cells"), "td"), is_head=whole.contains("Change") & whole.contains(":"))
    n = F.size("tds")
    part = F.split(text_at(F.col("tds"), 0), ":")
    starts = F.col("is_head") & (n > 0) & (F.size(part) >= 3)
    number = F.trim(F.replace(F.lower(F.get(part, F.size(part) - 1)), F.lit("race")))
    head = F.when(starts, F.struct(F.trim(F.get(part, F.lit(0))).alias("track"), F.when(number.rlike(r"^\d+$"), number.cast("int")).alias("race")))
    horse = F.when((n == 4) & text_at(F.col("tds"), 0).contains("#"), F.struct(F.replace(text_at(F.col("tds"), 0), F.lit("#")).alias("pgm"), text_at(F.col("tds"), 1).alias("horse")))
    again = (n == 3) & ~text_at(F.col("tds"), 0).contains("#")
    upto = Window.partitionBy("doc_id").orderBy("row_no").rowsBetween(Window.unboundedPreceding, 0)
    races = rows.select("*", F.last(head, True).over(upto).alias("head"), F.sum(F.col("is_head").cast("int")).over(upto).alias("block"), horse.alias("own"), again.alias("again"))
    within = Window.partitionBy("doc_id", "block").orderBy("row_no").rowsBetween(Window.unboundedPreceding, 0)
    carried = races.withColumn("horse", F.last("own", True).over(within)).where("NOT is_head AND head.track <> '' AND head.race IS NOT NULL AND (own IS NOT NULL OR again)")
    carried = _staged(carried, said=F.when(F.col("own").isNotNull(), text_at(F.col("tds"), 2)).otherwise(text_at(F.col("tds"), 1)))
    return carried.select(
        "doc_id", F.col("row_no").alias("line_no"), F.col("head.track").alias("track_name"), F.col("head.race").alias("race_number"), F.col("horse.pgm").alias("program_number"),
        F.col("horse.horse").alias("horse_name"), changes.change_type(F.col("said")).alias("change_type"), F.col("said").alias("description"),
    )


def extract_links(pages: DataFrame, pattern: str = r"""(?i)href\s*=\s*["']([^"'#?\s]+)""", key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, url): distinct link targets."""
    return pages.select(key, F.explode(F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(pattern), F.lit(1))).alias("url")).distinct()


def extract_change_links(pages: DataFrame) -> DataFrame:
    """(track_code, url) of an index of change pages."""
    return extract_links(pages, r"""(?i)href\s*=\s*["']([^"']*latechanges[^"']*)""").select(F.regexp_extract("url", r"latechanges([A-Z]{2,3})", 1).alias("track_code"), "url").where("track_code <> ''").distinct()


def extract_chart_races(pages: DataFrame) -> DataFrame:
    """(doc_id, page_no, text) -> (doc_id, segment, text): pages of a race joined in order."""
    from railbird.operators.dedupe import page_segments

    header = F.col("text").rlike(r"(?i)race\s*\d+") & F.col("text").rlike(r"(?i)(race|charts?)\b.*\d{4}|- race \d+")
    seg = page_segments(pages, header).where("segment > 0")
    return seg.groupBy("doc_id", "segment").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page_no", "text"))), lambda p: p["text"]), "\n").alias("text"))


def extract_chart_metadata(races: DataFrame) -> DataFrame:
    """(doc_id, segment, text) -> track, number, date, surface, distance, purse, race type, times."""
    t = F.col("text")
    low = F.lower(t)
    surface = F.when(low.contains("all weather") | low.contains("synthetic"), "Synthetic").when(low.contains("turf"), "Turf").when(low.contains("dirt"), "Dirt")
    races = _staged(races, title=_first(t, r"(?m)^\s*([A-Za-z' .]+?)\s*-\s*[A-Z][a-z]+ \d"), up=F.upper(t))
    kind = F.lit(None).cast("string")
    for word in ("STARTER ALLOWANCE", "MAIDEN SPECIAL WEIGHT", "MAIDEN CLAIMING", "ALLOWANCE OPTIONAL CLAIMING", "ALLOWANCE", "STAKES", "CLAIMING", "MAIDEN")[::-1]:
        kind = F.when(F.col("up").contains(word), F.initcap(F.lit(word))).otherwise(kind)
    return races.select(
        "doc_id", "segment",
        racing.canonical_track_name(F.col("title")).alias("track_name"),
        _first(t, r"(?i)race\s*(\d+)").cast("int").alias("race_number"), times.parse_text_date(t).alias("race_date"), surface.alias("surface"),
        F.trim(_first(t, r"(?i)distance:?\s*([^\n.]+)")).alias("distance"), racing.clean_purse(_first(t, r"(?i)purse:?\s*(\$?[\d,]+)")).alias("purse"), kind.alias("race_type"),
        _first(t, r"(?i)final time:?\s*([\d:.]+\d)").alias("final_time"), racing.fractional_times(_first(t, r"(?i)fractional times:?\s*([^\n]+)")).alias("fractions"),
    )


def _section(text: Column, start: str, stop: str) -> Column:
    return F.regexp_extract(F.coalesce(text, F.lit("")), rf"(?is)(?:{start})(.*?)(?:{stop}|\Z)", 1)


# A runner's line: number, name, then a place or a length in words.
RUNNER = r"^\s*(\d+[A-Z]?)\s+([A-Za-z][A-Za-z'&\-.]*(?:\s+[A-Za-z][A-Za-z'&\-.]*)*)\s+(?:\d+|Head|Neck|Nose)\b"


def extract_running_lines(races: DataFrame) -> DataFrame:
    """Finishers of the preview section, in order of their rows; a line that is no runner belongs to the last one, such as a length on a line of its own."""
    at = lines(races, keys=("doc_id", "segment")).withColumn("line", F.trim("line"))
    order = Window.partitionBy("doc_id", "segment").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    head, stop = F.col("line").rlike("(?i)Past Performance Running Line Preview"), F.col("line").rlike(r"(?i)^(Trainers:|Owners:|Footnotes|Copyright|Denotes\b)")
    part = at.withColumn("_in", F.sum(head.cast("int")).over(order)).where("_in > 0").withColumn("_end", F.max(stop).over(order))
    runners = part.where(F.col("line").rlike(RUNNER) & ~F.col("_end") & ~F.col("line").rlike(r"(?i)^Pgm\s+Horse\s+Name\b"))
    named = runners.select(
        "doc_id", "segment", "line_no", names.normalize_pgm(F.regexp_extract("line", RUNNER, 1)).alias("program_number"), F.trim(F.regexp_replace(names.squeeze(F.regexp_extract("line", RUNNER, 2)), r"[^\w\s'-]", "")).alias("horse_name")
    ).where("horse_name <> ''")
    place = F.row_number().over(Window.partitionBy("doc_id", "segment").orderBy("line_no"))
    return named.select("doc_id", "segment", place.alias("finish_position"), "program_number", "horse_name")


# What the name cell of a row that is no runner has in it; lower case.
TABLE_LABELS = ("preliminary", "mutuel", "total", "wps", "claiming", "footnote", "winner", "final time")


def extract_table_horses(cells: DataFrame) -> DataFrame:
    """(doc_id, table_no, row_no, cells) -> finishers: program_number, horse_name, jockey, trainer, odds, finish_position.

    Read are the rows below the first one of each document's largest table, and after them those of other tables
    whose first row has as many cells, give or take one, without repeated headers.  Rows of less than three cells,
    scratched ones and labels are no runners; places count runners, nameless ones too.
    """
    from railbird.operators.dedupe import finish_by_order

    # All windows are within a document, so that cells are shuffled once and not joined with what is known of their tables.
    document = Window.partitionBy("doc_id")
    table = document.orderBy("table_no").rangeBetween(Window.currentRow, Window.currentRow)
    shaped = cells.where("doc_id IS NOT NULL AND table_no IS NOT NULL").withColumns({"_n": F.count("*").over(table), "_width": F.min_by(F.size("cells"), "row_no").over(table), "_head": F.min("row_no").over(table)})
    largest = F.min(F.struct((-F.col("_n")).alias("n"), F.col("table_no").alias("no"), F.col("_width").alias("width"))).over(document)
    taken = shaped.withColumn("_first", largest).withColumn("later", F.col("table_no") != F.col("_first.no")).where("_first.n <= -2 AND (NOT later OR abs(_width - _first.width) <= 1)")
    said = F.lower(F.array_join("cells", " "))
    header = said.contains("horse") & (said.contains("jockey") | said.contains("pgm"))
    rows = taken.where(F.when(F.col("later"), ~header).otherwise(F.col("row_no") > F.col("_head"))).where(F.size("cells") >= 3)
    cell = lambda i: F.nullif(F.trim(F.get("cells", F.lit(i))), F.lit(""))
    label = F.exists(F.array(*map(F.lit, TABLE_LABELS)), lambda w: F.lower(cell(1)).contains(w))
    runners = rows.where(~said.contains("scratched") & ~F.array_contains(F.split(said, r"\s+"), "scr") & ~F.coalesce(label, F.lit(False)))
    placed = finish_by_order(runners.withColumn("place", F.struct("later", "table_no", "row_no")), ("doc_id",), "place")
    number = names.normalize_pgm(F.coalesce(cell(0), F.col("finish_position").cast("string")))
    name = F.regexp_replace(cell(1), r"[^\w\s'-]", "")
    return placed.select("doc_id", number.alias("program_number"), name.alias("horse_name"), cell(2).alias("jockey"), cell(3).alias("trainer"), cell(4).alias("odds"), "finish_position").where("horse_name <> ''")


def extract_text_horses(races: DataFrame) -> DataFrame:
    """Finishers (with jockey and odds) of lines 'LastRaced Pgm Name(Jockey) … odds …' below their header; of races with a running line preview, its finishers."""
    preview = extract_running_lines(races)
    at = lines(races.join(preview, ["doc_id", "segment"], "left_anti"), keys=("doc_id", "segment"))
    order = Window.partitionBy("doc_id", "segment").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    pattern = r"^\s*\S+\s+(\d+)\s+([^(]+)\(([^)]+)\).*?(\d+\.\d+\*?)\s+"
    head = F.col("line").contains("HorseName(Jockey)") | F.col("line").contains("Horse Name (Jockey)")
    stop = F.col("line").contains("Fractional Times") | F.col("line").contains("Final Time") | F.col("line").contains("Run-Up")
    part = at.withColumns({"_head": head, "_in": F.max(head).over(order)}).where("_in AND NOT _head").withColumn("_row", F.col("line").rlike(pattern))
    seen = part.withColumn("_seen", F.max("_row").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    open_ = seen.withColumn("_end", F.max(stop & F.coalesce("_seen", F.lit(False))).over(order)).where("_row AND NOT _end")
    part_of = lambda i: F.trim(F.regexp_extract("line", pattern, i))
    place = F.row_number().over(Window.partitionBy("doc_id", "segment").orderBy("line_no"))
    told = open_.select("doc_id", "segment", place.alias("finish_position"), part_of(1).alias("program_number"), part_of(2).alias("horse_name"), part_of(3).alias("jockey"), F.replace(part_of(4), F.lit("*")).alias("odds"))
    return told.unionByName(preview, allowMissingColumns=True)


def extract_wps_payouts(races: DataFrame) -> DataFrame:
    """(doc_id, segment, text) -> program_number, win, place, show by the rank of priced rows."""
    section = _section(F.col("text"), r"total wps pool[^\n]*\n|pgm\s+horse\s+win\s+place\s+show[^\n]*\n", r"past performance|trainers:|owners:")
    at = lines(races.select("doc_id", "segment", section.alias("text")), keys=("doc_id", "segment"))
    head = F.regexp_extract("line", r"(?i)^(.*?)(?=\$|\b(?:exacta|trifecta|superfecta|daily double|pick|quinella)\b|$)", 1)
    row = at.select("doc_id", "segment", "line_no", _first(head, r"^\s*(?:Pgm.*)?(\d{1,2}[A-Z]?)\s+[A-Z]").alias("program_number"), F.regexp_extract_all(head, F.lit(r"(\d+\.\d{2})"), F.lit(1)).alias("prices"))
    priced = row.where("program_number IS NOT NULL AND size(prices) > 0")
    rank = F.row_number().over(Window.partitionBy("doc_id", "segment").orderBy("line_no"))
    p = lambda i: F.get("prices", i).cast("decimal(10,2)")
    n = F.size("prices")
    return priced.withColumn("rank", rank).where("rank <= 3").select(
        "doc_id", "segment", names.normalize_pgm(F.col("program_number")).alias("program_number"),
        F.when(F.col("rank") == 1, p(F.lit(0))).alias("win"),
        F.when((F.col("rank") == 1) & (n > 1), p(F.lit(1))).when(F.col("rank") == 2, p(F.lit(0))).alias("place"), F.when(n > (3 - F.col("rank")), p(F.lit(3) - F.col("rank"))).alias("show"),
    )


def extract_exotic_payouts(races: DataFrame) -> DataFrame:
    """wager_type, payout: the first amount of each of six wagers."""
    out = F.array(*(F.struct(F.lit(k).alias("wager_type"), F.replace(_first(F.col("text"), rf"(?i){k}[^\n$]*?\s\$?([\d,]+\.\d{{2}})"), F.lit(",")).cast("decimal(10,2)").alias("payout")) for k in ("Exacta", "Trifecta", "Superfecta", "Daily Double", "Pick 3", "Quinella")))
    return races.select("doc_id", "segment", F.explode(out).alias("w")).select("doc_id", "segment", "w.*").where("payout IS NOT NULL")


def extract_trainers(races: DataFrame) -> DataFrame:
    section = F.regexp_replace(_section(F.col("text"), r"trainers:", r"owners:|footnotes|claiming|\n\n"), r"\s+", " ")
    part = races.select("doc_id", "segment", F.explode(F.split(section, ";")).alias("part"))
    pattern = r"^\s*(\d{1,2}[A-Z]?)\s*-\s*(.+?)\s*$"
    return part.select("doc_id", "segment", names.normalize_pgm(_first(F.col("part"), pattern)).alias("program_number"), _first(F.col("part"), pattern, 2).alias("trainer_name")).where("trainer_name IS NOT NULL")


def extract_scratched_names(races: DataFrame) -> DataFrame:
    """Names of the scratched section, without what stands in brackets."""
    stop = r"\s+Trainers:|\s+Owner\(s\):|\s+Footnotes|\s+Claiming|\s+Total\s*WPS|\s+Pgm\s+Horse|\s+Mutuel\s+Prices|\s+Winner:|\s+Final\s+Time"
    section = F.regexp_replace(_section(F.col("text"), r"Scratched\s*Horse\(s\)\s*:", stop), r"\s+", " ")
    each = races.select("doc_id", "segment", F.explode(F.split(section, r"[;,]\s*")).alias("part"))
    name = F.trim(F.regexp_replace(F.trim("part"), r"\s*\(.*?\)", ""))
    return each.select("doc_id", "segment", name.alias("scratched_name")).where((F.length(names.normalize_name(F.col("scratched_name"))) >= 3) & (F.length("scratched_name") <= 35))


def extract_claims(races: DataFrame) -> DataFrame:
    """horse_name, new_trainer_name, new_owner_name, claim_price: a line with 'New Trainer:' starts a claim, others go on with it."""
    section = F.regexp_replace(_section(F.col("text"), r"claimed horse(?:\(s\)|s)?:?", r"total wps|past performance|footnotes|\n\n"), r"New\s*Ow\s*\|?\s*ner", "New Owner")
    at = lines(races.select("doc_id", "segment", section.alias("text")), keys=("doc_id", "segment")).where("trim(line) <> ''")
    order = Window.partitionBy("doc_id", "segment").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    whole = at.withColumn("row", F.sum(F.col("line").contains("New Trainer:").cast("int")).over(order)).where("row > 0").groupBy("doc_id", "segment", "row").agg(
        names.squeeze(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), " ")).alias("line")
    )
    prices = races.select("doc_id", "segment", F.explode(F.regexp_extract_all("text", F.lit(r"\$?\d[\d,]*\.?\d*\s+claim(?:ed|ing price)[^\n]*|Claiming Price[^\n]*"), F.lit(0))).alias("p"))
    price = prices.groupBy("doc_id", "segment").agg(F.max(F.regexp_replace(_first(F.col("p"), r"(\$?\d[\d,]*)"), r"[$,]", "").cast("decimal(12,2)")).alias("claim_price"))
    return whole.select(
        "doc_id", "segment", "row", F.trim(_first(F.col("line"), r"^(.*?)\s*New Trainer:")).alias("horse_name"), F.trim(_first(F.col("line"), r"New Trainer:\s*(.*?)\s*(?:New Owner:|$)")).alias("new_trainer_name"),
        F.trim(_first(F.col("line"), r"New Owner:\s*(.*?)\s*$")).alias("new_owner_name"),
    ).join(price, ["doc_id", "segment"], "left")


def extract_entry_tables(pages: DataFrame) -> DataFrame:
    """(doc_id, html) -> entries of tables whose headers speak of two columns of a card at least; the n-th such table is race n.

    The horse's name is in the cell's h4, strong or link, else its first line; the cell of trainer and jockey has a line for each.
    """
    columns = [("race_number", pa.int32()), ("row_no", pa.int32()), *((n, pa.string()) for n in ("program_number", "horse_name", "trainer_name", "jockey_name", "odds"))]
    cards = page_rows(pages, ("doc_id",), entry_rows, columns)
    return cards.withColumn("horse_name", names.clean_horse_name(F.col("horse_name"))).select("doc_id", "race_number", "row_no", "program_number", "horse_name", "trainer_name", "jockey_name", "odds")


def extract_static_entries(pages: DataFrame) -> DataFrame:
    """(doc_id, html) of cards in blocks ``div#RaceN`` -> entries with what the block says of the race.

    A block's ``contenders`` have a ``row`` per horse: its saddlecloth, its name in the link of an h4, labelled links to jockey and trainer, odds.  SCR in
    the number scratches.  A block without contenders may have a table instead: saddlecloths, links by kind, odds in a cell.
    """
    entry = pa.struct([("line_no", pa.int32()), *((n, pa.string()) for n in ("number", "name", "jockey_name", "trainer_name", "odds"))])
    columns = [("number", pa.string()), ("race_type", pa.string()), ("told", pa.string()), ("in_rows", pa.bool_()), ("entries", pa.list_(entry))]
    parts = F.filter(F.transform(F.split("told", r"\|"), lambda t: F.trim(t)), lambda t: (t != "") & (t != "."))
    blocks = _staged(page_rows(pages, ("doc_id",), card_blocks, columns), parts=parts)
    timed = lambda t: t.contains("PM") | t.contains("AM")
    long = lambda t: ~timed(t) & F.upper(t).rlike(" F| Y|MILE|FURLONG")
    last = lambda f: F.try_element_at(F.filter("parts", f), F.lit(-1))
    clock = F.filter(F.transform(F.filter("parts", timed), lambda t: F.regexp_extract(t, r"(?i)(\d{1,2}:\d{2}\s+(?:AM|PM))", 1)), lambda t: t != "")
    is_surface = lambda t: F.lower(t).isin("dirt", "turf", "all weather", "synthetic", "outer turf", "inner turf")
    heads = blocks.select(
        "doc_id", F.col("number").cast("int").alias("race_number"), "in_rows", "race_type", F.try_element_at(clock, F.lit(-1)).alias("post_time"), last(long).alias("distance"), F.coalesce(last(is_surface), F.lit("Dirt")).alias("surface"),
        racing.clean_purse(last(lambda t: ~timed(t) & ~long(t) & t.startswith("$"))).alias("purse"), F.explode("entries").alias("e"),
    )
    name = F.when(F.col("in_rows"), F.col("e.name")).otherwise(F.regexp_replace("e.name", r"\s*\(.*?\)", ""))
    out = F.upper("e.number").contains("SCR")
    return heads.select(
        "doc_id", "race_number", "e.line_no", F.col("e.number").alias("program_number"), names.clean_horse_name(name).alias("horse_name"), "e.jockey_name", "e.trainer_name",
        F.when(out, "SCR").otherwise(F.col("e.odds")).alias("odds"), out.alias("scratched"), "race_type", "post_time", "distance", "surface", "purse",
    )


def extract_race_schedule(pages: DataFrame) -> DataFrame:
    """(doc_id, html) -> doc_id, track_code, start_date, end_date: of a table row, the code in its second cell and all ranges in it; of a code told twice the last row counts."""
    from railbird.operators.dedupe import first_by

    rows = table_rows(pages)
    tds = of_tag(F.col("cells"), "td")
    rows = _staged(rows, code=F.upper(text_at(tds, 1)), said=F.array_join(F.transform(tds, lambda c: plain(c["text"])), " ")).where("code rlike '^[A-Z0-9]{2,4}$'")
    day = lambda m, i: F.to_date(F.try_to_timestamp(F.get(F.regexp_extract_all(m, F.lit(r"(\d{2}/\d{2}/\d{4})"), F.lit(1)), F.lit(i)), F.lit("MM/dd/yyyy")))
    spans = F.transform(F.regexp_extract_all("said", F.lit(r"\d{2}/\d{2}/\d{4}\s*-\s*\d{2}/\d{2}/\d{4}"), F.lit(0)), lambda m: F.struct(day(m, 0).alias("start_date"), day(m, 1).alias("end_date")))
    valid = rows.select("doc_id", F.col("code").alias("track_code"), "row_no", F.filter(spans, lambda s: s["start_date"].isNotNull() & s["end_date"].isNotNull()).alias("spans")).where("size(spans) > 0")
    return first_by(valid, ["doc_id", "track_code"], [F.desc("row_no")]).select("doc_id", "track_code", F.explode("spans").alias("s")).select("doc_id", "track_code", "s.*")
