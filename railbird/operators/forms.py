"""Past-performance forms: pages of lines, as text.

Lines are rows; a number alone opens an entry, the first line after it that stands above
breeding or a life record is its horse.  What state a line is in (before the post time, after a number, after
its horse) comes from running counts within the page, which of them a page's race is from those over pages.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from railbird.functions import names, racing, times

# What a form has of a horse's record and breeding; of embedded entries and of later pages.
EMBEDDED = ("Life", "Sire:", ".m.", ".g.", ".f.")
BREEDING = ("Life", ".m.", ".g.", ".f.", ".c.")
# Words that tell a track's line from a horse's.
TRACK_WORDS = ("GULFSTREAM", "WOODBINE", "PARK", "DOWNS", "AQUEDUCT", "BELMONT", "KEENELAND", "SARATOGA", "DEL MAR", "SANTA ANITA")
RACE_TYPES = ("CLAIMING", "ALLOWANCE", "STAKES", "MAIDEN", "HANDICAP")
# Short names that forms use, by code, in the order of their preference.
FORM_TRACKS = (
    ("GULFSTREAM", "GP"), ("WOODBINE", "WO"), ("AQUEDUCT", "AQU"), ("BELMONT", "BEL"), ("CHURCHILL", "CD"), ("SANTAANITA", "SA"), ("SARATOGA", "SAR"), ("KEENELAND", "KEE"),
    ("DELMAR", "DMR"), ("FAIRGROUNDS", "FG"), ("SAMHOUSTON", "HOU"), ("TAMPABAY", "TAM"),
)
INDEX = "INDEXTOENTRIES"
POST_TIME = r"(?i)Post\s*time[:\s]*(\d{1,2}:\d{2})\s*(?:[AP]M)?\s*(?:ET|PT|CT|MT)?"
NAME = r"^([A-Za-z']+)"


def _first(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(F.coalesce(text, F.lit("")), pattern, group), F.lit(""))


def _closed(text: Column) -> Column:
    """Upper case, without spaces."""
    return F.upper(F.replace(F.coalesce(text, F.lit("")), F.lit(" ")))


def _says(text: Column, parts: tuple[str, ...]) -> Column:
    return text.rlike("|".join(map(re.escape, parts)))


def _staged(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that later expressions read and don't repeat: a generator keeps projections apart."""
    return df.select("*", F.explode(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))).alias("_s")).select("*", "_s.*").drop("_s")


def extract_form_header(pages: DataFrame) -> DataFrame:
    """(doc_id, page_no, text) -> track_code, race_date of each form: from its first page, what stands before the index before the rest."""
    first = pages.groupBy("doc_id").agg(F.min_by("text", "page_no").alias("text"))
    before = F.split_part(F.col("text"), F.lit(INDEX), F.lit(1))
    head = F.when(F.trim(before) == "", F.array_join(F.slice(F.split("text", "\n"), 1, 5), "\n")).otherwise(before)

    def code(text):  # noqa: ANN001, ANN202
        out = F.when(F.lit(False), F.lit(""))
        for name, known in FORM_TRACKS:
            out = out.when(_closed(text).contains(name), known)
        return out

    # Names of other tracks that cards use, where no short name is found.
    found = F.coalesce(code(head), code(F.col("text")), racing.track_code_from_text(head, F.col("text")))
    return first.select("doc_id", found.alias("track_code"), F.coalesce(times.parse_text_date(F.regexp_extract("text", r"\((\d{1,2}/\d{1,2}/\d{4})\)", 1)), times.parse_text_date(F.col("text"))).alias("race_date"))


def form_track_name(code: Column) -> Column:
    """The name that an index page is followed by; null without a code."""
    out = F.when(F.lit(False), F.lit(""))
    for known, name in racing.TRACKS.items():
        out = out.when(code == known, name)
    return out


def trim_index_page(text: Column, track_name: Column) -> Column:
    """An index page from the first race on: from a line '1' above the track's name; '' if there is none.  A page without an index stays."""
    rows = F.split(F.coalesce(text, F.lit("")), "\n")
    track = _closed(track_name)
    after = F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0)))
    at = F.array_position(F.zip_with(F.slice(rows, 1, F.greatest(F.size(rows) - 1, F.lit(0))), F.transform(after, lambda n: _closed(F.trim(n))), lambda l, n: (F.trim(l) == "1") & (n.contains(track) | track.contains(n))), True)
    cut = F.when(track_name.isNotNull() & (at > 0), F.array_join(F.slice(rows, at.cast("int"), F.size(rows)), "\n")).otherwise("")
    return F.when(_closed(text).contains(INDEX), cut).otherwise(text)


def detect_form_race_pages(pages: DataFrame) -> DataFrame:
    """Adds race_number and header_line: a number alone in the first six lines, with a track in the three lines below it and no life record or sire."""
    # Ten lines and the rest: a header reads nothing below its ninth line.
    cut = _staged(pages, _rows=F.split(F.coalesce("text", F.lit("")), "\n", 11))
    at, n = F.sequence(F.lit(0), F.least(F.lit(5), F.size("_rows") - 3)), F.size("_rows")
    near = lambda i: F.upper(F.array_join(F.slice("_rows", i + 2, 3), " "))
    told = _staged(cut, _near=F.when(n >= 4, F.transform(at, lambda i: F.struct(i.alias("i"), F.trim(F.get("_rows", i)).alias("number"), near(i).alias("near")))))
    fits = lambda x: x["number"].rlike(r"^\d+$") & _says(x["near"], TRACK_WORDS) & ~_says(x["near"], ("LIFE", "SIRE:"))
    found = _staged(told, _head=F.get(F.filter("_near", fits), F.lit(0)))
    return found.select(*pages.columns, F.col("_head.i").alias("header_line"), F.expr("try_cast(_head.number AS int)").alias("race_number"))


def extract_form_race(pages: DataFrame) -> DataFrame:
    """Race header pages -> distance, feet, surface, race type, purse, post time, conditions."""
    pages = _staged(detect_form_race_pages(pages).where("race_number IS NOT NULL"), _up=F.upper("text"))
    pages = _staged(pages, _long=_first(F.col("_up"), r"(\d+[\sÔô]*(?:FURLONG|MILE|YARD)S?)"))
    t, up = F.col("text"), F.col("_up")
    rows = F.transform(F.slice(F.split("text", "\n"), 5, 6), lambda l: F.trim(l))
    told = F.filter(rows, lambda l: l.rlike("^(For|Weight|Fillies|ClaimingPrice)") | l.contains("Year") | l.contains("Upward"))
    kind = F.when(F.lit(False), F.lit(""))
    for k in RACE_TYPES:
        kind = kind.when(up.contains(k), k.title())
    distance = racing.parse_distance(F.col("_long"))
    purse = _first(t, r"Purse\$?([\d,]+)")
    return pages.select(
        "doc_id", "page_no", "race_number", distance["label"].alias("distance"), distance["feet"].alias("distance_feet"),
        F.when(up.contains("TURF"), "Turf").when(_says(up, ("TAPETA", "SYNTHETIC")), "Synthetic").otherwise("Dirt").alias("surface"), kind.alias("race_type"),
        F.concat(F.lit("$"), purse).alias("purse"), _first(t, POST_TIME).alias("post_time"), F.nullif(F.array_join(told, " "), F.lit("")).alias("conditions"),
    )


def _lines(pages: DataFrame) -> DataFrame:
    at = pages.select("doc_id", "page_no", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "line"))
    return at.withColumn("below", F.coalesce(F.lead("line").over(Window.partitionBy("doc_id", "page_no").orderBy("line_no")), F.lit("")))


def extract_embedded_horses(pages: DataFrame) -> DataFrame:
    """Entries on a race's header page: after the line of the post time, a number of one or two digits alone, then the first line above a record, a sire or breeding."""
    page = Window.partitionBy("doc_id", "page_no").orderBy("line_no")
    upto = page.rowsBetween(Window.unboundedPreceding, 0)
    timed = _lines(pages).withColumn("_time", F.col("line").contains("Posttime:"))
    after = timed.withColumn("_after", F.max("_time").over(upto)).where("_after AND NOT _time")
    number = F.col("line").rlike(r"^\s*\d{1,2}\s*$")
    marked = after.withColumn("_number", number).withColumn("_hit", ~number & _says(F.col("below"), EMBEDDED))
    carried = marked.withColumns({"_entry": F.sum(F.col("_number").cast("int")).over(upto), "program_number": F.last(F.when(F.col("_number"), F.trim("line")), True).over(upto)})
    turn = Window.partitionBy("doc_id", "page_no", "_entry").orderBy("line_no")
    first = carried.where("_hit AND _entry > 0").withColumn("_turn", F.row_number().over(turn)).where("_turn = 1")
    return first.select("doc_id", "page_no", "line_no", "program_number", names.normalize_horse_name(_first(F.col("line"), NAME)).alias("horse_name")).where("horse_name <> ''")


def detect_form_entry_pages(pages: DataFrame) -> DataFrame:
    """Adds is_entry_page: a page that goes on with horses.  Its second line is a number alone, its first 500
    characters speak of a life record or a sire, and its third line is a horse with breeding in it."""
    row = F.split("text", "\n")
    line = lambda i: F.coalesce(F.get(row, F.lit(i)), F.lit(""))
    head = F.upper(F.substring("text", 1, 500))
    fits = (F.size(row) >= 3) & F.trim(line(1)).rlike(r"^\d+$") & _says(head, ("LIFE", "SIRE:")) & line(2).rlike(r"^[A-Za-z']") & _says(line(2), BREEDING)
    return pages.withColumn("is_entry_page", F.coalesce(fits, F.lit(False)))


def extract_form_horses(pages: DataFrame) -> DataFrame:
    """(doc_id, page_no, text) -> program_number, horse_name: a number from 1 to 20 alone, above a line with a name and breeding; the name is that line's first word."""
    number = F.when(F.col("line").rlike(r"^\s*\d{1,2}\s*$"), F.trim("line").cast("int"))
    rows = _lines(pages).withColumn("n", number).where(F.col("n").between(1, 20) & _says(F.col("below"), BREEDING))
    return rows.select("doc_id", "page_no", "line_no", F.col("n").cast("string").alias("program_number"), names.normalize_horse_name(_first(F.col("below"), NAME)).alias("horse_name")).where("horse_name <> ''")


def extract_form_entry_details(entries: DataFrame) -> DataFrame:
    """(…, text) of an entry -> equipment, medication, weight (of an L and three digits), trainer_name."""
    t = F.col("text")
    dosed = F.coalesce(t, F.lit("")).rlike(r"\bL\d{3}\b")
    return entries.withColumns({
        "equipment": F.when(_closed(t).contains("BLINKERSON"), "Blinkers"), "medication": F.when(dosed, "Lasix"),
        "weight": F.when(dosed, _first(t, r"L(\d{3})").cast("int")), "trainer_name": F.trim(_first(t, r"Tr:\s*([A-Z][A-Za-z\s.]+?)(?:\(|2025:|Life)")),
    })


def assemble_form_races(pages: DataFrame) -> DataFrame:
    """Form pages -> doc_id, race_number, program_number, horse_name.

    The first page loses its index.  A header page starts a race with the entries on it; pages that go on with horses belong
    to the race before them, or to race 1 before any header, and win over entries of header pages; of a race told twice the later telling wins.
    """
    from railbird.operators.dedupe import first_by

    name = extract_form_header(pages).select("doc_id", form_track_name(F.col("track_code")).alias("_track"))
    first = F.col("page_no") == F.min("page_no").over(Window.partitionBy("doc_id"))
    trimmed = pages.join(name, "doc_id").withColumn("_first", first).withColumn("text", F.when(F.col("_first"), trim_index_page(F.col("text"), F.col("_track"))).otherwise(F.col("text"))).drop("_first", "_track").where("text <> ''")
    marked = detect_form_entry_pages(detect_form_race_pages(trimmed))
    upto = Window.partitionBy("doc_id").orderBy("page_no").rowsBetween(Window.unboundedPreceding, 0)
    headed = F.col("race_number").isNotNull()
    placed = marked.select(
        "doc_id", "page_no", "text", headed.alias("_header"), "is_entry_page", F.sum(headed.cast("int")).over(upto).alias("_turn"), F.coalesce(F.last("race_number", True).over(upto), F.lit(1)).alias("race_number")
    )
    told = extract_embedded_horses(placed.where("_header")).withColumn("_detail", F.lit(False)).unionByName(extract_form_horses(placed.where("NOT _header AND is_entry_page")).withColumn("_detail", F.lit(True)))
    entries = told.join(placed.select("doc_id", "page_no", "race_number", "_turn"), ["doc_id", "page_no"])
    best = first_by(entries, ["doc_id", "race_number", "program_number"], [F.desc("_turn"), F.desc("_detail"), F.desc("page_no"), F.desc("line_no")])
    return best.select("doc_id", "race_number", "program_number", "horse_name")
