"""Truth tables of the column functions."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from railbird.functions import changes, money, names, racing, times


def values(spark, f, *inputs):
    rows = [(i, *(x if isinstance(x, tuple) else (x,))) for i, x in enumerate(inputs)]
    width = len(rows[0])
    df = spark.createDataFrame(rows, "i int, " + ", ".join(f"c{k} string" for k in range(1, width)))
    return [r[0] for r in df.orderBy("i").select(f(*(F.col(f"c{k}") for k in range(1, width)))).collect()]


@pytest.mark.parametrize(
    ("function", "cases"),
    [
        (changes.valid_cancellation, {"Race Cancelled": True, "Race 1 Cancelled due to weather": True, "Entire card Cancelled": True, "Show Wagering Cancelled": False, "Superfecta Wagering Cancelled": False,
                                      "Pick 5 Pool Cancelled": False, "Simulcast Cancelled": False, "Turf Racing Cancelled": False, "Cancelled - wind": False, None: False}),
        (changes.change_type, {"First Start Since Reported as Gelding - Y": "Horse Note", "Scratched - Vet": "Scratch", "Blinkers on": "Equipment Change", "Race Cancelled": "Race Cancelled", "Show Wagering Cancelled": "Wagering", "x": "Other", None: "Other"}),
        (changes.change_type_rss, {"Scratch Reason - Vet": "Other", "Post Time changed to 1:30 PM": "Post Time Change", "Show Wagering Cancelled": "Wagering", "Pick 5 Pool Cancelled": "Other"}),
        (changes.normalize_change_description, {"A; A - Y": "A", " a  b ;c-  d; A B": "a b; c - d", "": "", None: ""}),
        (changes.extract_new_post_time, {"Post Time changed to 1:30 PM": "1:30 PM", "changed to 12:45": "12:45", "Jockey changed to Smith": None, None: None}),
        (names.normalize_name, {"Royal Salute (IRE)": "royalsalute", "O'Neil's": "oneils", None: ""}),
        (names.normalize_pgm, {"01a": "1A", "0": "0", "": "0", None: "0", " 10 ": "10", "#5": "5"}),
        (names.normalize_person_name, {"  o'neil  SMITH-jones ": "O'Neil Smith-Jones", None: ""}),
        (names.clean_horse_name, {"Nyfive (97)": "Nyfive", "A Lister (IRE)": "A Lister", " ": "Unknown", None: "Unknown"}),
        (names.valid_horse_name, {"$5": False, "-x": False, "12,5": False, "A": False, "Bold": True, "TBD": False, None: False}),
        (names.program_order, {"1A": 1, "12": 12, "A": 999, None: 999}),
        (names.sex_label, {"G": "Gelding", "x": "x", None: None}),
        (times.format_12h, {"14:05:00": "2:05 PM", "9:30": "9:30 AM", "1:30 PM ET": "1:30 PM", "Post Time 1:30PM": "1:30 PM", "N/A": "N/A", "soon": "soon", None: None}),
        (times.parse_rfc822_date, {"Tue, 06 Jan 2026 23:15:00 EST": dt.date(2026, 1, 6), "junk": None, None: None}),
        (times.parse_text_date, {"x (1/2/2026)": dt.date(2026, 1, 2), "SATURDAY, APRIL 18, 2026": dt.date(2026, 4, 18), "Apr 6, 2026": dt.date(2026, 4, 6), "none": None}),
        (racing.parse_odds, {"3-1": "3-1", "5/2": "5-2", "7": "7-1", "EVN": "EVN", "": None, None: None}),
        (lambda c: racing.parse_distance(c)["feet"], {"6F": 3960, "1 MILE (TURF)": 660, "1 Mile": 5280, "1 1/8 Miles": 5940, "350 Yards": 1050, "x": None, "": None, None: None}),
        (lambda c: racing.parse_distance(c)["label"], {"6 furlongs": "6 Furlongs", "2 Miles": "2 Miles", "1 1/16 miles": "1 1/16 Miles"}),
        (racing.clean_purse, {"$44,000": "$44000", "": None, None: None}),
        (racing.merge_split_currency, {"Purse $5, 000 added": "Purse $5000 added", "$12,500": "$12500"}),
        (racing.fractional_times, {"22.41 45.90 1:10.55 58.02 99.00 23.00": "22.41, 45.90, 58.02, 23.00", None: ""}),
        (racing.canonical_track_name, {"at GULFSTREAM PARK today": "Gulfstream Park", "New Course": "New Course", "12#": None}),
        (racing.country_code, {"WO": "CAN", "GP": "USA"}),
        (racing.track_timezone, {"SA": "America/Los_Angeles", "WO": "America/Toronto", "XX": "America/New_York", None: "America/New_York"}),
    ],
)
def test_truth_table(spark, function, cases):
    assert values(spark, function, *cases) == list(cases.values())


def test_change_identity(spark):
    cases = [("05", "x"), ("-", "Bold"), (None, "Race-Wide"), ("", None), ("0", "Bold")]
    assert values(spark, names.change_identity, *cases) == ["PGM_5", "bold", "RACE_WIDE", "RACE_WIDE", "bold"]


def test_type_class_and_keep(spark):
    cases = [("Other", "Scratch reason changed"), ("Jockey Change", None), ("Race Cancelled", ""), (None, None)]
    assert values(spark, changes.change_type_class, *cases) == ["scratch", "jockey", "cancelled", "other"]
    rows = [("Bold", "Scratch", ""), (None, "Scratch", "x"), ("Race-wide", "Race Cancelled", ""), ("", "Other", " "), ("", "Other", "Rail 10ft"), (None, "Post Time Change", None)]
    assert values(spark, changes.keep_change, *rows) == [True, False, True, False, True, True]


def test_post_ts_and_live_status(spark):
    rows = [("2026-01-06", "1:30 PM", "upcoming"), ("2026-07-06", "13:30:00", "upcoming"), ("2026-01-06", None, None), ("2026-01-06", "1:30 PM", "past_drf_only"), ("2026-01-06", "1:30 PM", "delayed"), ("2026-01-06", "2:30 PM", "upcoming")]
    at = values(spark, lambda d, t, s: times.post_ts(d.cast("date"), t, F.lit("America/New_York")).cast("string"), *rows)
    assert at[:3] == ["2026-01-06 18:30:00", "2026-07-06 17:30:00", None]
    now = F.lit("2026-01-06 18:50:00").cast("timestamp")
    got = values(spark, lambda d, t, s: times.live_status(d.cast("date"), t, s, F.lit("America/New_York"), F.lit(False), now), *rows)
    assert got == ["past", "upcoming", "upcoming", "past", "delayed", "upcoming"]


def test_chart_url(spark):
    d = F.lit("2026-04-25").cast("date")
    assert values(spark, lambda c: racing.chart_url("", c, d, F.lit(1)), "WO")[0] == "WO042526CAN1.pdf"
    assert tuple(values(spark, racing.parse_chart_url, "http://x/WO042526CAN1.pdf")[0]) == ("WO", dt.date(2026, 4, 25), 1)


def test_key_combos_against_enumeration(spark):
    import itertools
    import json

    lists = [[["1"], ["2", "3"]], [["1", "2"], ["1", "2", "3"]], [["1", "2"], ["2", "3"], ["1", "3", "4"]], [["1"], ["1"], ["1"]], [["1"]]]
    want = [sum(len(set(p)) == len(p) for p in itertools.product(*x)) if len(x) > 1 else 0 for x in lists]
    got = values(spark, lambda c: money.key_combos(F.from_json(c, "array<array<string>>")), *map(json.dumps, lists))
    assert got == want


def test_win_pct_rounds_to_even(spark):
    df = spark.createDataFrame([(1, 16), (0, 0), (1, 3)], "w long, n long")
    assert [float(r[0]) for r in df.select(money.win_pct(F.col("w"), F.col("n"))).collect()] == [6.2, 0.0, 33.3]


def test_names_keep_ascii_only(spark):
    got = spark.sql("SELECT 'Café  Noir (IRE) 2' n UNION ALL SELECT cast(null as string)").select(names.normalize_name(F.col("n"))).collect()
    assert sorted(r[0] for r in got) == ["", "cafnoir2"]


def test_charts_of_the_last_century(spark):
    c = spark.sql("SELECT 'GP040698USA3.pdf' u UNION ALL SELECT 'WO042526CAN1.pdf' UNION ALL SELECT 'GP139998USA3.pdf'").select(racing.parse_chart_url(F.col("u")).alias("c")).select("c.*").collect()
    assert sorted((r.track_code, str(r.race_date), r.race_number) for r in c) == [("GP", "1998-04-06", 3), ("GP", "None", 3), ("WO", "2026-04-25", 1)]


def test_pages_of_a_wall(spark):
    from railbird.operators.filters import classify_page

    said = {"": "success", "short": "blocked", "Access Denied <title>404": "blocked", "<TITLE>404": "no_card", "x" * 6000 + "incapsula": "success", "y" * 6000 + "<title>404": "no_card", "z" * 5000: "success"}
    df = spark.createDataFrame([(k,) for k in said] + [(None,)], "h string")
    assert {r.h or "": r.s for r in df.select("h", classify_page(F.col("h")).alias("s")).collect()} == said
