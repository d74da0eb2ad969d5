"""Joins.  Sides are never broadcast by hint; Spark does so where it has seen a side's size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from railbird.functions.names import normalize_name, normalize_pgm

GRAM = 3


def join_track(df: DataFrame, tracks: DataFrame) -> DataFrame:
    return df.join(tracks, "track_code", "left")


def join_entry_dims(entries: DataFrame, horses: DataFrame, jockeys: DataFrame) -> DataFrame:
    return entries.join(horses, "horse_id", "left").join(jockeys, "jockey_id", "left")


def with_race(df: DataFrame, races: DataFrame) -> DataFrame:
    """Rows that have a race, with its columns."""
    return df.join(races, "race_id")


def nest(parents: DataFrame, children: DataFrame, key: str, name: str, *order: str) -> DataFrame:
    """``parents`` with their children as an array of structs, in order; none: an empty array."""
    rest = [c for c in children.columns if c != key and c not in order]
    packed = children.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, *rest))).alias(name))
    kind = packed.schema[name].dataType.simpleString()
    return parents.join(packed, key, "left").withColumn(name, F.coalesce(name, F.array().cast(kind)))


def semi_by_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key), key, "left_semi")


def exists_flag(df: DataFrame, other: DataFrame, key: str, name: str) -> DataFrame:
    marked = other.select(key).distinct().withColumn(name, F.lit(True))
    return df.join(marked, key, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def anti_detailed_scratch(entries: DataFrame, changes: DataFrame) -> DataFrame:
    """Scratched entries that no Scratch change tells of."""
    told = changes.where("change_type = 'Scratch' AND entry_id IS NOT NULL").select("entry_id")
    return entries.where("scratched").join(told, "entry_id", "left_anti")


def zombie_entries(stored: DataFrame, results: DataFrame, least: int = 3) -> DataFrame:
    """Stored entries not in the results of their race, where these have ``least`` rows or more."""
    known = results.groupBy("race_id").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("race_id")
    return stored.where(~F.coalesce("scratched", F.lit(False))).join(known, "race_id", "left_semi").join(
        results.select("race_id", "program_number"), ["race_id", "program_number"], "left_anti"
    )


def hydrate(df: DataFrame, snapshots: DataFrame, key: str, *columns: str) -> DataFrame:
    """Blank or null ``columns`` are looked up in ``snapshots``."""
    looked = snapshots.select(key, *(F.col(c).alias(f"_{c}") for c in columns))
    out = df.join(looked, key, "left")
    for c in columns:
        inline = F.nullif(F.col(c), F.lit("")) if dict(df.dtypes)[c] == "string" else F.col(c)
        out = out.withColumn(c, F.coalesce(inline, F.col(f"_{c}")))
    return out.drop(*(f"_{c}" for c in columns))


def match_entries(changes: DataFrame, entries: DataFrame, keep: Column | None = None) -> DataFrame:
    """Finds each change's entry by program number, else by name in the race; changes of a
    horse that has none go, but for those that ``keep`` holds for.  Needs change_id, race_id, program_number, horse_name."""
    # A race's entries lie in one row, so that they are shuffled once for both ways.
    known = F.struct("entry_id", normalize_pgm(F.col("program_number")).alias("pgm"), normalize_name(F.col("horse_name")).alias("name"))
    runners = entries.groupBy("race_id").agg(F.collect_list(known).alias("_runners"))
    least = lambda test: F.array_min(F.transform(F.filter("_runners", test), lambda x: x["entry_id"]))
    out = (
        changes.withColumn("_pgm", F.when(F.col("program_number").isNotNull(), normalize_pgm(F.col("program_number"))))
        .withColumn("_name", F.nullif(normalize_name(F.col("horse_name")), F.lit("")))
        .join(runners, "race_id", "left")
        .withColumn("entry_id", F.coalesce(least(lambda x: x["pgm"] == F.col("_pgm")), least(lambda x: x["name"] == F.col("_name"))))
    )
    race_wide = F.col("_pgm").isNull() & F.col("_name").isNull()
    return out.where(F.col("entry_id").isNotNull() | race_wide | (F.lit(False) if keep is None else keep)).drop("_pgm", "_name", "_runners")


def match_name_in_race(left: DataFrame, right: DataFrame, left_name: str = "horse_name", right_name: str = "horse_name") -> DataFrame:
    """Pairs of rows of a race with equal normalised names."""
    a = left.withColumn("norm_name", normalize_name(F.col(left_name)))
    b = right.withColumn("norm_name", normalize_name(F.col(right_name))).drop(right_name)
    return a.where("norm_name <> ''").join(b, ["race_id", "norm_name"])


def match_scratch_names(scratches: DataFrame, entries: DataFrame) -> DataFrame:
    """Scratched names to entries of the race: equal, or contained if four characters or more; first entry wins."""
    s = scratches.withColumn("_s", normalize_name(F.col("scratched_name"))).where(F.length("_s") >= 3)
    e = entries.select("race_id", "entry_id", normalize_name(F.col("horse_name")).alias("_e"))
    hit = (F.col("_s") == F.col("_e")) | ((F.length("_s") >= 4) & F.col("_e").contains(F.col("_s")))
    pairs = s.join(e, "race_id").where(hit)
    first = Window.partitionBy("race_id", "scratched_name").orderBy((F.col("_s") != F.col("_e")).cast("int"), "entry_id")
    return pairs.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n", "_s", "_e")


def match_payouts(horses: DataFrame, payouts: DataFrame, trainers: DataFrame) -> DataFrame:
    """Win, place and show payouts and missing trainers by race and program number."""
    out = horses.join(payouts, ["race_id", "program_number"], "left").join(trainers.withColumnRenamed("trainer_name", "_t"), ["race_id", "program_number"], "left")
    return out.withColumn("trainer_name", F.coalesce(F.nullif("trainer_name", F.lit("")), F.col("_t"))).drop("_t")


def schedule_join(tracks: DataFrame, schedule: DataFrame, day: str) -> DataFrame:
    """has_card: true, false, or null for tracks the schedule doesn't know."""
    d = F.lit(day).cast("date")
    known = schedule.groupBy("track_code").agg(F.bool_or(d.between(F.col("start_date"), F.col("end_date"))).alias("has_card"))
    return tracks.join(known, "track_code", "left")


def first_exotic(exotics: DataFrame, label: str) -> DataFrame:
    """race_id, payout: the first exotic wager, as stored, whose type contains ``label``."""
    return exotics.where(F.lower("wager_type").contains(label.lower())).groupBy("race_id").agg(F.min_by("payout", "seq").alias("exotic_payout"))


def count_default(tracks: DataFrame, totals: DataFrame) -> DataFrame:
    return tracks.join(totals, "track_code", "left").withColumn("total", F.coalesce("total", F.lit(0)).cast("long"))


def _grams(text: Column) -> Column:
    """The runs of ``GRAM`` characters of a text; of a shorter one none."""
    at = F.when(F.length(text) >= GRAM, F.sequence(F.lit(1), F.length(text) - GRAM + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(at, lambda i: F.substr(text, i, F.lit(GRAM))))


def lookup_horse(requests: DataFrame, horses: DataFrame) -> DataFrame:
    """request, outcome, matches, horse_id: equal names first, else names that contain the request.

    outcome is matched, ambiguous or not_found; horse_id only for matched.  Requests may be any number: a name
    contains a request only if it contains its rarest run of three characters, on which the two are joined.  Shorter
    requests are joined on the names' runs of their own length; an empty one is in every name.
    """
    r = requests.withColumn("_r", F.lower(F.trim("request")))
    # A row for each name, however many horses have it.  Compressed sizes say little of what runs of characters come to, so these joins are merged, not broadcast.
    h = horses.groupBy(F.lower("horse_name").alias("_h")).agg(F.count("*").alias("_horses"), F.min("horse_id").alias("_least"))
    exact = r.join(h.hint("merge"), F.col("_r") == F.col("_h")).groupBy("request").agg(F.sum("_horses").alias("n1"), F.min("_least").alias("h1"))
    asked = r.join(exact.select("request").hint("merge"), "request", "left_anti").select("request", "_r").distinct()
    width = F.least(F.length("_r"), F.lit(GRAM))
    parts = lambda k: F.transform(F.when(F.length("_h") >= k, F.sequence(F.lit(1), F.length("_h") - k + 1)).otherwise(F.array().cast("array<int>")), lambda i: F.substr(F.col("_h"), i, F.lit(k)))
    named = h.select("_h", "_horses", "_least", F.explode(F.array_distinct(F.concat(F.array(F.lit("")), *(parts(k) for k in range(1, GRAM + 1))))).alias("gram"))
    often = named.groupBy("gram").agg(F.count("*").alias("often"))
    wanted = asked.select("request", "_r", F.explode(F.when(width < GRAM, F.array("_r")).otherwise(_grams(F.col("_r")))).alias("gram"))
    rarest = wanted.join(often.hint("merge"), "gram").groupBy("request", "_r").agg(F.min_by("gram", F.struct("often", "gram")).alias("gram"))
    part = rarest.join(named.hint("merge"), "gram").where(F.col("_h").contains(F.col("_r"))).groupBy("request").agg(F.sum("_horses").alias("n2"), F.min("_least").alias("h2"))
    out = r.join(exact.hint("merge"), "request", "left").join(part.hint("merge"), "request", "left")
    n = F.coalesce("n1", "n2", F.lit(0))
    return out.select(
        "request",
        F.when(n == 0, "not_found").when(n == 1, "matched").otherwise("ambiguous").alias("outcome"),
        n.cast("long").alias("matches"),
        F.when(n == 1, F.coalesce("h1", "h2")).alias("horse_id"),
    )


def match_claim_price(claims: DataFrame, prices: DataFrame) -> DataFrame:
    """Adds claim_price: that of the equal name in the race, else of the first (seq) name that contains
    the claim's or is contained in it.  Claims: race_id, claim_id, horse_name; prices: race_id, seq, priced_name, price."""
    c = claims.withColumn("_c", normalize_name(F.col("horse_name")))
    p = prices.select("race_id", "seq", normalize_name(F.col("priced_name")).alias("_p"), "price").where("_p <> ''")
    fits = (F.col("_c") == F.col("_p")) | F.col("_c").contains(F.col("_p")) | F.col("_p").contains(F.col("_c"))
    rank = F.struct((F.col("_c") != F.col("_p")).alias("inexact"), "seq")
    found = c.where("_c <> ''").join(p, "race_id").where(fits).groupBy("claim_id").agg(F.min_by("price", rank).alias("claim_price"))
    return claims.join(found, "claim_id", "left")
