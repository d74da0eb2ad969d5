"""Keys, distances, odds, and tracks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names that race cards and charts use, and their codes.
TRACKS = {
    "AQU": "Aqueduct", "BAQ": "Belmont at the Big A", "BEL": "Belmont Park", "CD": "Churchill Downs", "CT": "Charles Town", "DED": "Delta Downs", "DMR": "Del Mar",
    "EVD": "Evangeline Downs", "FG": "Fair Grounds", "GG": "Golden Gate Fields", "GP": "Gulfstream Park", "HOU": "Sam Houston Race Park", "IND": "Indiana Grand",
    "KEE": "Keeneland", "LRL": "Laurel Park", "MVR": "Mahoning Valley", "MNR": "Mountaineer Park", "OP": "Oaklawn Park", "PEN": "Penn National", "PIM": "Pimlico",
    "PRX": "Parx Racing", "SA": "Santa Anita Park", "SAR": "Saratoga", "TAM": "Tampa Bay Downs", "TP": "Turfway Park", "TUP": "Turf Paradise", "WO": "Woodbine",
}
ZONES = {
    "America/Chicago": ("DED", "EVD", "FG", "HOU", "OP"),
    "America/Los_Angeles": ("DMR", "GG", "SA"),
    "America/Phoenix": ("TUP",),
    "America/Toronto": ("WO",),
}
CANONICAL_TRACKS = {"WO": "Woodbine"}


def race_key(track_code: Column, race_date: Column, race_number: Column) -> Column:
    return F.concat_ws("-", track_code, F.date_format(race_date, "yyyyMMdd"), race_number.cast("string"))


def track_of_key(key: Column) -> Column:
    return F.split_part(key, F.lit("-"), F.lit(1))


def country_code(track_code: Column) -> Column:
    return F.when(track_code == "WO", "CAN").otherwise("USA")


def chart_url(base: str, track_code: Column, race_date: Column, race_number: Column) -> Column:
    return F.concat(F.lit(base), track_code, F.date_format(race_date, "MMddyy"), country_code(track_code), race_number.cast("string"), F.lit(".pdf"))


def parse_chart_url(url: Column) -> Column:
    """struct(track_code, race_date, race_number) of a name such as WO042526CAN1.pdf; nulls if it isn't one."""
    pattern = r"([A-Z]{2,3})(\d{6})(?:USA|CAN)(\d+)\.pdf"
    part = lambda i: F.nullif(F.regexp_extract(url, pattern, i), F.lit(""))
    year = F.right(part(2), F.lit(2)).cast("int")
    whole = F.concat(F.left(part(2), F.lit(4)), F.when(year >= 69, year + 1900).otherwise(year + 2000).cast("string"))
    return F.struct(part(1).alias("track_code"), F.to_date(F.try_to_timestamp(whole, F.lit("MMddyyyy"))).alias("race_date"), part(3).cast("int").alias("race_number"))


def clean_purse(text: Column) -> Column:
    digits = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^0-9]", "")
    return F.when(digits != "", F.concat(F.lit("$"), digits))


def merge_split_currency(text: Column) -> Column:
    """Amounts that a split at commas would take apart, without the commas."""
    return F.regexp_replace(F.regexp_replace(text, r"(\$\d{1,3}),\s*(\d{3})(?!\d)", "$1$2"), r"(\$\d{4,6}),\s*(\d{3})(?!\d)", "$1$2")


def parse_odds(text: Column) -> Column:
    t = F.nullif(F.trim(text), F.lit(""))
    return F.when(t.rlike(r"^\d+-\d+"), t).when(t.contains("/"), F.replace(t, F.lit("/"), F.lit("-"))).when(t.rlike(r"^\d+$"), F.concat(t, F.lit("-1"))).otherwise(t)


def parse_distance(text: Column) -> Column:
    """struct(label, feet).  An F anywhere means furlongs, and only the first number counts, as cards are read today."""
    t = F.upper(F.trim(F.nullif(text, F.lit(""))))
    numbers = F.regexp_extract_all(t, F.lit(r"(\d+)"), F.lit(1))
    at = lambda i: F.get(numbers, F.lit(i)).cast("int")
    has = at(0).isNotNull()
    fraction = t.contains("/") & at(2).isNotNull()
    furlongs, miles, yards = t.contains("F") & has, t.contains("M") & ~t.contains("/") & has, t.contains("Y") & has
    parted = t.contains("M") & fraction
    label = (
        F.when(furlongs, F.concat(at(0), F.lit(" Furlongs")))
        .when(parted, F.concat(at(0), F.lit(" "), at(1), F.lit("/"), at(2), F.lit(" Miles")))
        .when(miles, F.concat(at(0), F.when(at(0) > 1, " Miles").otherwise(" Mile")))
        .when(yards, F.concat(at(0), F.lit(" Yards")))
        .otherwise(t)
    )
    feet = F.when(furlongs, at(0) * 660).when(parted, F.floor((at(0) + at(1) / F.nullif(at(2), F.lit(0))) * 5280).cast("int")).when(miles, at(0) * 5280).when(yards, at(0) * 3)
    return F.struct(label.alias("label"), feet.alias("feet"))


def fractional_times(text: Column) -> Column:
    """The first four decimals between 20 and 70, joined."""
    found = F.filter(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(\d{2}\.\d{2})"), F.lit(1)), lambda x: (x.cast("double") > 20) & (x.cast("double") < 70))
    return F.array_join(F.slice(found, 1, 4), ", ")


def canonical_track_name(text: Column) -> Column:
    """The first known name that the text contains; else the text if it looks like a name, else null."""
    low = F.lower(F.coalesce(text, F.lit("")))
    out = F.when(F.lit(False), F.lit(""))
    for name in TRACKS.values():
        out = out.when(low.contains(name.lower()), name)
    plain = F.trim(text)
    return out.when(plain.rlike(r"^[A-Za-z .'&-]{3,40}$"), plain)


def track_code_from_text(header: Column, whole: Column) -> Column:
    """The code of the first known name in the header, else in the whole text."""
    def of(text):  # noqa: ANN001, ANN202
        low, out = F.lower(F.coalesce(text, F.lit(""))), F.when(F.lit(False), F.lit(""))
        for code, name in TRACKS.items():
            out = out.when(low.contains(name.lower()), code)
        return out

    return F.coalesce(of(header), of(whole))


def track_timezone(code: Column) -> Column:
    out = F.when(code.isNull(), "America/New_York")
    for zone, codes in ZONES.items():
        out = out.when(code.isin(*codes), zone)
    return out.otherwise("America/New_York")


def track_display_name(name: Column, code: Column) -> Column:
    return F.coalesce(F.nullif(name, F.lit("")), F.when(code == "WO", "Woodbine"), code)
