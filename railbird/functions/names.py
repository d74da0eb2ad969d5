"""Names, program numbers, and the identity of what a change is about."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F



def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def normalize_name(name: Column) -> Column:
    """Without bracketed parts, ASCII letters and digits only ('Café' is 'caf'), lower case; null counts as empty."""
    bare = F.regexp_replace(F.coalesce(name, F.lit("")), r"\([^)]*\)", "")
    return F.lower(F.regexp_replace(bare, r"[^A-Za-z0-9]", ""))


def normalize_pgm(number: Column) -> Column:
    """Upper-case letters and digits without leading zeros; nothing left is '0'."""
    bare = F.regexp_replace(F.upper(F.coalesce(number.cast("string"), F.lit(""))), r"[^A-Z0-9]", "")
    left = F.ltrim(bare, F.lit("0"))
    return F.when(left == "", F.lit("0")).otherwise(left)


def normalize_horse_name(name: Column) -> Column:
    return F.upper(squeeze(F.coalesce(name, F.lit(""))))


def normalize_person_name(name: Column) -> Column:
    """Title case: a capital after everything that isn't a letter."""
    parts = F.regexp_extract_all(F.lower(squeeze(F.coalesce(name, F.lit("")))), F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 10_000))), "")


def clean_horse_name(raw: Column) -> Column:
    """Without trailing brackets such as a speed figure; empty is 'Unknown'."""
    bare = F.trim(F.regexp_replace(F.trim(F.regexp_replace(squeeze(F.coalesce(raw, F.lit(""))), r"\s*\(\d+\*?\)$", "")), r"\s*\([^)]*\)$", ""))
    return F.when(bare == "", F.lit("Unknown")).otherwise(bare)


def valid_horse_name(name: Column) -> Column:
    return F.coalesce(
        (F.length(name) >= 2) & ~name.startswith("$") & ~name.startswith("-") & ~name.rlike(r"^[\d\s.,\-$]+$") & ~name.isin("-", "--", "N/A", "Unknown", "TBD"),
        F.lit(False),
    )


def space_count(name: Column) -> Column:
    return F.length(name) - F.length(F.replace(name, F.lit(" ")))


def program_order(number: Column) -> Column:
    """The number a program number starts with; 999 if none."""
    return F.coalesce(F.nullif(F.regexp_extract(number.cast("string"), r"^\s*(\d+)", 1), F.lit("")).cast("int"), F.lit(999))


def change_identity(program_number: Column, horse_name: Column) -> Column:
    """PGM_n, else the lower-case horse name, else RACE_WIDE."""
    pgm = F.ltrim(F.upper(F.trim(F.coalesce(program_number.cast("string"), F.lit("")))), F.lit("0"))
    horse = F.lower(F.trim(F.coalesce(horse_name, F.lit(""))))
    return (
        F.when((pgm != "") & ~pgm.isin("-", "NONE", "NULL"), F.concat(F.lit("PGM_"), pgm))
        .when(horse.isin("", "race-wide", "unknown", "none", "null"), F.lit("RACE_WIDE"))
        .otherwise(horse)
    )


def sex_label(code: Column) -> Column:
    # Registry codes.
    labels = {"C": "Colt", "F": "Filly", "G": "Gelding", "H": "Horse", "M": "Mare", "R": "Ridgling"}
    return F.coalesce(F.create_map(*(F.lit(x) for kv in labels.items() for x in kv))[F.upper(code)], code)


def status_label(status: Column) -> Column:
    return F.initcap(F.replace(F.coalesce(status, F.lit("unknown")), F.lit("_"), F.lit(" ")))
