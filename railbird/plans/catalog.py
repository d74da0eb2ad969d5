"""Queries by name, over whole tables, with SQL twins where there are any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from railbird.functions import changes as ch
from railbird.functions import money, names, racing, times
from railbird.operators import aggregates as agg
from railbird.operators import betting, dedupe, extract, filters, joins, ordering, sets
from railbird.plans import products
from railbird.sources import tables
from railbird.sources.views import AS_OF_DATE, AS_OF_TS, EVENTS_AS_OF, Racing, cte
from railbird.streaming import changes as late
from railbird.streaming import health

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
MAY_BE_EMPTY = ("filter_family", "failure_burst")  # on the smallest tables


def query(*views: str, sql: str | None = None):
    """Registers a function of the racing tables under its name; ``sql`` may read the ``views``."""

    def add(f: Callable[[Racing], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Racing(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = (cte(*views) + "\n" if views else "") + sql
        return f

    return add


def _d(x: str):  # noqa: ANN202
    return F.col(x).cast("double").alias(x)


# --- scans, writes ---------------------------------------------------------------------------

@query("v_races", sql="SELECT race_key, track_code, race_date, race_status FROM v_races")
def scan_table(r):
    return r.races.select("race_key", "track_code", "race_date", "race_status")


@query("v_entries_raw", sql="""
  , old AS (SELECT DISTINCT race_id, line + 1 AS line, 0.0 AS price, 0 AS horse_id FROM v_entries_raw),
  new AS (SELECT race_id, line, price, horse_id FROM (SELECT *, row_number() OVER (PARTITION BY race_id, line ORDER BY shipped DESC, price DESC, horse_id DESC, jockey_id DESC) AS n FROM v_entries_raw) WHERE n = 1)
  SELECT race_id, line, horse_id, price FROM new UNION ALL SELECT race_id, line, horse_id, price FROM old WHERE NOT EXISTS (SELECT 1 FROM new WHERE new.race_id = old.race_id AND new.line = old.line)""")
def upsert(r):
    rows = r.entries_raw.select("shipped", "price", "horse_id", "jockey_id", "race_id", "line")
    old = rows.select("race_id", (F.col("line") + 1).alias("line")).distinct().select(F.lit(None).cast("timestamp").alias("shipped"), F.lit(0.0).alias("price"), F.lit(0).cast("long").alias("horse_id"), F.lit(0).cast("long").alias("jockey_id"), "race_id", "line")
    return tables.upsert(old, rows, ["race_id", "line"], ["shipped", "price", "horse_id", "jockey_id"]).select("race_id", "line", "horse_id", "price")


@query("v_races", sql="""
  SELECT race_id, CASE WHEN race_id % 2 = 0 THEN 'Sloppy' ELSE surface END AS surface, CASE WHEN race_id % 2 = 0 AND race_id % 3 = 0 THEN '18:30:00' ELSE post_time END AS post_time FROM v_races""")
def upsert_nonnull(r):
    old = r.races.select("race_id", "surface", "post_time")
    new = old.where("race_id % 2 = 0").select("race_id", F.lit("Sloppy").alias("surface"), F.when(F.col("race_id") % 3 == 0, "18:30:00").alias("post_time"))
    return tables.upsert_nonnull(old, new, ["race_id"])


@query("v_races", sql="SELECT race_id, coalesce(post_time, '13:00:00') AS post_time FROM v_races")
def fill_if_missing(r):
    old = r.races.select("race_id", "post_time")
    return tables.fill_if_missing(old, old.select("race_id", F.lit("13:00:00").alias("post_time")), "race_id", "post_time")


@query("v_changes", sql="SELECT change_id, race_id, program_number, description, program_number IS NOT NULL AS good FROM v_changes")
def insert_with_quarantine(r):
    good, bad = tables.quarantine(r.changes.select("change_id", "race_id", "program_number", "description"), F.col("program_number") != "0")
    return good.withColumn("good", F.lit(True)).union(bad.withColumn("good", F.lit(False)))


@query("v_tracks", sql="SELECT track_code, track_name FROM v_tracks UNION ALL SELECT 'WO', 'Woodbine'")
def insert_if_absent(r):
    old = r.tracks.select("track_code", "track_name")
    seeds = r.spark.createDataFrame([("T01", "other"), ("WO", "Woodbine")], "track_code string, track_name string")
    return tables.insert_if_absent(old, seeds, ["track_code"])


@query("v_races", sql="SELECT race_id, CASE WHEN is_cancelled THEN 'reset' ELSE race_status END AS race_status FROM v_races")
def update_where(r):
    return tables.update_where(r.races.select("race_id", "race_status", "is_cancelled"), F.col("is_cancelled"), race_status=F.lit("reset")).drop("is_cancelled")


@query("v_races", "v_entries", sql="SELECT e.entry_id, e.race_id FROM v_entries e JOIN v_races r ON r.race_id = e.race_id WHERE NOT r.is_cancelled")
def delete_where(r):
    return tables.delete_where(r.races, F.col("is_cancelled"), entries=(r.entries, "race_id"))["entries"].select("entry_id", "race_id")


@query("v_jockeys", "v_horses", sql="""
  SELECT sha256(upper(n)) AS person_id, n AS person_name FROM (SELECT DISTINCT trim(horse_name) AS n FROM v_horses WHERE horse_name NOT IN (SELECT jockey_name FROM v_jockeys))
  UNION ALL SELECT cast(jockey_id as varchar), jockey_name FROM v_jockeys""")
def get_or_create_dim(r):
    dim = r.jockeys.select(F.col("jockey_id").cast("string").alias("person_id"), F.col("jockey_name").alias("person_name"))
    return tables.get_or_create_dim(dim, r.horses.select(F.col("horse_name").alias("person_name")), "person_id", "person_name")


@query("v_crawl_events", sql="""
  SELECT 'run-1' AS run_id, min(seen_at) AS started_at, count(*) AS requests, count(*) FILTER (WHERE kind = 'success') AS succeeded, count(*) FILTER (WHERE kind = 'failure') AS failed,
         cast(floor(epoch(max(seen_at))) - floor(epoch(min(seen_at))) AS BIGINT) AS duration_seconds FROM v_crawl_events""")
def append_crawl_log(r):
    return tables.crawl_log(r.crawl_events, "run-1")


@query("v_crawl_events", sql="""
  SELECT user_key AS upload_id, arg_max(kind, struct_pack(a := seen_at, b := kind)) AS status, max(seen_at) AS logged_at FROM (SELECT event_id % 97 AS user_key, kind, seen_at FROM v_crawl_events) GROUP BY 1""")
def upload_state(r):
    return tables.upload_state(r.crawl_events.select((F.col("event_id") % 97).alias("upload_id"), F.col("kind").alias("status"), F.col("seen_at").alias("logged_at")))


# --- filters ---------------------------------------------------------------------------------

@query("v_races", sql=f"""
  SELECT race_id, race_key FROM v_races WHERE race_status = 'completed' AND track_code IN ('T01','T02','T03') AND race_date BETWEEN DATE '1996-01-01' AND DATE '1998-12-31'
    AND race_number > 1 AND cancellation_reason IS NULL AND surface <> 'Turf' AND race_date <= DATE '{AS_OF_DATE}'""")
def filter_family(r):
    c = F.col
    return r.races.where(
        (c("race_status") == "completed") & c("track_code").isin("T01", "T02", "T03") & c("race_date").between(F.lit("1996-01-01").cast("date"), F.lit("1998-12-31").cast("date"))
        & (c("race_number") > 1) & c("cancellation_reason").isNull() & (c("surface") != "Turf") & (c("race_date") <= F.lit(AS_OF_DATE).cast("date"))
    ).select("race_id", "race_key")


@query("v_horses", sql="SELECT horse_id, horse_name FROM v_horses WHERE horse_name ILIKE '%re%' AND NOT horse_name LIKE '$%' AND horse_name NOT IN ('-', '--', 'N/A')")
def filter_ilike(r):
    return r.horses.where(filters.ilike(F.col("horse_name"), "re") & filters.not_placeholder(F.col("horse_name"))).select("horse_id", "horse_name")


@query("v_horses", sql="""
  SELECT x, length(x) >= 2 AND left(x, 1) NOT IN ('$', '-') AND NOT regexp_full_match(x, '[0-9\\s.,$-]+') AND x NOT IN ('-', '--', 'N/A', 'Unknown', 'TBD') AS ok
  FROM (SELECT CASE horse_id % 6 WHEN 0 THEN horse_name WHEN 1 THEN '$' || horse_name WHEN 2 THEN cast(horse_id as varchar) WHEN 3 THEN 'TBD' WHEN 4 THEN left(horse_name, 1) ELSE '-- ' END AS x FROM v_horses)""")
def valid_horse_name(r):
    k, n = F.col("horse_id") % 6, F.col("horse_name")
    x = F.when(k == 0, n).when(k == 1, F.concat(F.lit("$"), n)).when(k == 2, F.col("horse_id").cast("string")).when(k == 3, "TBD").when(k == 4, F.left(n, F.lit(1))).otherwise("-- ")
    return r.horses.select(x.alias("x")).select("x", names.valid_horse_name(F.col("x")).alias("ok"))


@query("v_races", sql="SELECT DISTINCT split_part(race_key, '-', 1) AS track_code FROM v_races WHERE race_key LIKE '%-19980601-%'")
def race_key_like_date(r):
    return filters.active_tracks(r.races, AS_OF_DATE)


@query("v_races", sql=f"""
  SELECT 'upcoming' AS view, race_id FROM v_races WHERE race_date = DATE '{AS_OF_DATE}' UNION ALL SELECT 'history', race_id FROM v_races WHERE race_date < DATE '{AS_OF_DATE}'
  UNION ALL SELECT 'dated', race_id FROM v_races WHERE race_date >= DATE '1997-01-01' AND race_date <= DATE '1997-03-01'""")
def filter_view_dates(r):
    parts = {"upcoming": ("", ""), "history": ("", ""), "dated": ("1997-01-01", "1997-03-01")}
    out = [filters.view_dates(r.races, v, AS_OF_DATE, *dates).select(F.lit(v).alias("view"), "race_id") for v, dates in parts.items()]
    return out[0].union(out[1]).union(out[2])


@query("v_races", "v_tracks", sql="SELECT race_id FROM v_races JOIN v_tracks USING (track_code) WHERE track_code = 'T06' OR track_name = 'T06'")
def filter_track(r):
    return filters.track(joins.join_track(r.races, r.tracks), "T06").select("race_id")


@query("v_entries", sql="SELECT entry_id FROM v_entries WHERE NOT scratched")
def filter_scratched(r):
    return filters.scratched(r.entries, False).select("entry_id")


_FEED_SQL = """, f AS (
  SELECT change_id, race_id, entry_id, program_number, change_type, description, created_at AS change_time, 0 AS source_rank FROM v_changes
  UNION ALL
  SELECT entry_id, race_id, entry_id, program_number, 'Scratch', 'Scratched', NULL, 1 FROM v_entries e
  WHERE scratched AND NOT EXISTS (SELECT 1 FROM v_changes c WHERE c.change_type = 'Scratch' AND c.entry_id = e.entry_id)
), g AS (
  SELECT f.*, r.race_key, r.race_date, r.track_code, r.race_number, coalesce(h.horse_name, 'Race-wide') AS horse_name, coalesce(f.program_number, e.program_number, '-') AS pgm
  FROM f JOIN v_races r ON r.race_id = f.race_id LEFT JOIN v_entries e ON e.entry_id = f.entry_id LEFT JOIN v_horses h ON h.horse_id = e.horse_id
  WHERE f.entry_id IS NOT NULL OR f.program_number IS NULL
), k AS (
  SELECT *, CASE WHEN lower(change_type) LIKE '%scratch%' OR (lower(description) LIKE '%scratch%' AND lower(description) LIKE '%reason%') THEN 'scratch'
                 WHEN lower(change_type) LIKE '%jockey%' THEN 'jockey' WHEN lower(change_type) LIKE '%weight%' THEN 'weight' WHEN lower(change_type) LIKE '%cancelled%' THEN 'cancelled' ELSE 'other' END AS cls,
         CASE WHEN ltrim(upper(trim(pgm)), '0') NOT IN ('', '-', 'NONE', 'NULL') THEN 'PGM_' || ltrim(upper(trim(pgm)), '0')
              WHEN lower(horse_name) IN ('race-wide', 'unknown') THEN 'RACE_WIDE' ELSE lower(horse_name) END AS who
  FROM g
  WHERE horse_name <> 'Race-wide' OR (NOT regexp_matches(lower(change_type), 'scratch|jockey|weight|equipment') AND (regexp_matches(lower(change_type), 'cancelled|post time') OR trim(description) <> ''))
), u AS (
  SELECT *, row_number() OVER (PARTITION BY track_code, race_date, race_number, who, cls, CASE WHEN who = 'RACE_WIDE' THEN lower(left(trim(description), 30)) ELSE '' END
                               ORDER BY change_time DESC NULLS LAST, source_rank, change_id) AS n FROM k
), w AS (
  SELECT change_id, race_id, race_key, race_date, track_code, race_number, entry_id, pgm AS program_number, horse_name, CASE WHEN cls = 'scratch' AND change_type = 'Other' THEN 'Scratch' ELSE change_type END AS change_type, description, change_time, cls
  FROM u WHERE n = 1
), v AS (SELECT * FROM w WHERE change_type <> 'Wagering' AND lower(description) NOT LIKE '%wagering%')
"""
_FEED_VIEWS = ("v_changes", "v_entries", "v_races", "v_horses")
_FEED_COLUMNS = ("change_id", "race_key", "race_date", "track_code", "race_number", "entry_id", "program_number", "horse_name", "change_type", "description", "change_time")


@query(*_FEED_VIEWS, sql=_FEED_SQL + f"SELECT {', '.join(_FEED_COLUMNS)} FROM v WHERE horse_name <> 'Race-wide' AND entry_id IS NOT NULL")
def change_feed(r):
    return products.change_feed(r, "all", AS_OF_DATE).select(*_FEED_COLUMNS)


@query(*_FEED_VIEWS, sql=_FEED_SQL + f"SELECT {', '.join(_FEED_COLUMNS)} FROM v WHERE race_date < DATE '{AS_OF_DATE}'")
def change_feed_history_race_wide(r):
    return products.change_feed(r, "history", AS_OF_DATE, race_wide=True).select(*_FEED_COLUMNS)


@query(*_FEED_VIEWS, sql=_FEED_SQL + "SELECT coalesce(entry_id, change_id) AS id, race_key, program_number, horse_name, 'Scratched' AS status, description FROM v WHERE horse_name <> 'Race-wide' AND entry_id IS NOT NULL AND (cls = 'scratch')")
def scratch_feed(r):
    return products.scratch_feed(r, "all", AS_OF_DATE).select("id", "race_key", "program_number", "horse_name", "status", "description")


@query(*_FEED_VIEWS, sql=_FEED_SQL + "SELECT race_id, change_id, change_type FROM v")
def race_changes(r):
    return products.race_changes(r, r.races, True).select("race_id", "change_id", "change_type")


@query(*_FEED_VIEWS, sql=_FEED_SQL + "SELECT min(race_date) AS min_date, max(race_date) AS max_date, count(*) AS items, 'upcoming' AS requested_view, 'all' AS applied_view, true AS fallback_applied FROM v WHERE horse_name <> 'Race-wide' AND entry_id IS NOT NULL")
def feed_with_fallback(r):
    feed, applied = products.feed_with_fallback(r, "upcoming", "2030-01-01")
    return agg.feed_metadata(feed, "upcoming", applied)


@query("v_changes", sql="""
  SELECT change_id, contains(lower(description), 'cancel') AND NOT regexp_matches(lower(description), 'wagering|simulcast|pool|turf racing|superfecta|trifecta|exacta|daily double|pick|quinella|win|place|show|omnibus') AS ok FROM v_changes""")
def valid_cancellation(r):
    return r.changes.select("change_id", ch.valid_cancellation(F.col("description")).alias("ok"))


@query("v_changes", sql="SELECT change_id, program_number, coalesce(trim(program_number), '0') NOT IN ('', '0') AS good FROM (SELECT change_id, CASE change_id % 5 WHEN 0 THEN ' 0 ' WHEN 1 THEN ' ' ELSE program_number END AS program_number FROM v_changes)")
def valid_program_number(r):
    told = F.when(F.col("change_id") % 5 == 0, " 0 ").when(F.col("change_id") % 5 == 1, " ").otherwise(F.col("program_number"))
    good, bad = filters.valid_programs(r.changes.select("change_id", told.alias("program_number")))
    return good.withColumn("good", F.lit(True)).union(bad.withColumn("good", F.lit(False)))


@query(sql="""
  WITH v AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN html WHEN 1 THEN '<TITLE>404 gone' || html WHEN 2 THEN left(html, 900) || ' Request Unsuccessful. ' WHEN 3 THEN '404 - File or directory not found.' ELSE html || repeat(' no races today, access denied ', 300) END AS h FROM pages)
  SELECT page_id, CASE WHEN length(h) BETWEEN 1 AND 4999 AND (contains(lower(h), 'visid_incap') OR contains(lower(h), 'incap_ses') OR contains(lower(h), 'request unsuccessful') OR contains(lower(h), 'access denied') OR contains(lower(h), 'incapsula')) THEN 'blocked'
    WHEN contains(lower(h), '404 - file or directory not found') OR contains(lower(h), '<title>404') THEN 'no_card' WHEN length(h) BETWEEN 1 AND 4999 THEN 'blocked' ELSE 'success' END AS state FROM v""")
def classify_page(r):
    k, html = F.col("page_id") % 5, F.col("html")
    said = (
        F.when(k == 0, html).when(k == 1, F.concat(F.lit("<TITLE>404 gone"), html)).when(k == 2, F.concat(F.left(html, F.lit(900)), F.lit(" Request Unsuccessful. ")))
        .when(k == 3, "404 - File or directory not found.").otherwise(F.concat(html, F.repeat(F.lit(" no races today, access denied "), 300)))
    )
    return r.source("pages").select("page_id", filters.classify_page(said).alias("state"))


@query(sql="""
  WITH m AS (SELECT page_id, unnest(regexp_extract_all(coalesce(html, ''), '(?i)href\\s*=\\s*["'']([^"''#?\\s]+)', 1)) AS url FROM pages) SELECT DISTINCT page_id, url FROM m""")
def extract_links(r):
    return extract.extract_links(r.source("pages"))


@query("v_races", "v_tracks", sql=f"SELECT race_id FROM v_races JOIN v_tracks USING (track_code) WHERE race_date <= DATE '{AS_OF_DATE}' AND race_status IN ('completed', 'past_drf_only', 'cancelled') AND lower(track_name) LIKE '%nation%'")
def search_results(r):
    return filters.search_results(products.past_races(r, AS_OF_DATE).withColumn("winner_name", F.lit("")), "NATION").select("race_id")


# --- joins -----------------------------------------------------------------------------------

@query("v_races", "v_tracks", sql="SELECT race_id, track_name, timezone FROM v_races LEFT JOIN v_tracks USING (track_code)")
def join_track(r):
    return joins.join_track(r.races, r.tracks).select("race_id", "track_name", "timezone")


@query("v_entries", "v_horses", "v_jockeys", sql="SELECT entry_id, horse_name, jockey_name FROM v_entries LEFT JOIN v_horses USING (horse_id) LEFT JOIN v_jockeys USING (jockey_id)")
def join_entry_dims(r):
    return joins.join_entry_dims(r.entries, r.horses, r.jockeys).select("entry_id", "horse_name", "jockey_name")


@query("v_races", "v_entries", sql="SELECT race_id, coalesce(string_agg(program_number, ',' ORDER BY entry_id) FILTER (WHERE entry_id IS NOT NULL), '') AS programs FROM v_races LEFT JOIN v_entries USING (race_id) GROUP BY race_id")
def nest_children(r):
    return joins.nest(r.races.select("race_id"), r.entries.select("race_id", "entry_id", "program_number"), "race_id", "entries", "entry_id").select(
        "race_id", F.array_join(F.transform("entries", lambda e: e["program_number"]), ",").alias("programs")
    )


@query("v_races", "v_entries", sql="SELECT entry_id FROM v_entries WHERE race_id IN (SELECT race_id FROM v_races WHERE track_code = 'T05')")
def semi_by_ids(r):
    return joins.semi_by_ids(r.entries, r.races.where("track_code = 'T05'"), "race_id").select("entry_id")


@query("v_races", "v_claims", sql="SELECT race_id, race_id IN (SELECT race_id FROM v_claims) AS has_claims FROM v_races")
def exists_flag(r):
    return joins.exists_flag(r.races.select("race_id"), r.claims, "race_id", "has_claims")


@query("v_entries", "v_changes", sql="SELECT entry_id FROM v_entries e WHERE scratched AND NOT EXISTS (SELECT 1 FROM v_changes c WHERE c.change_type = 'Scratch' AND c.entry_id = e.entry_id)")
def anti_detailed_scratch(r):
    return joins.anti_detailed_scratch(r.entries, r.changes).select("entry_id")


@query("v_entries", sql="""
  , res AS (SELECT race_id, program_number FROM v_entries WHERE finish_position IS NOT NULL AND program_number <> '2'), ok AS (SELECT race_id FROM res GROUP BY 1 HAVING count(*) >= 3)
  SELECT entry_id FROM v_entries e WHERE NOT scratched AND race_id IN (SELECT race_id FROM ok) AND NOT EXISTS (SELECT 1 FROM res WHERE res.race_id = e.race_id AND res.program_number = e.program_number)""")
def zombie_entries(r):
    return joins.zombie_entries(r.entries, r.entries.where("finish_position IS NOT NULL AND program_number <> '2'")).select("entry_id")


@query("v_changes", "v_races", sql="SELECT change_id, coalesce(nullif(CASE WHEN change_id % 2 = 0 THEN '' ELSE 'XX' END, ''), track_code) AS track_code FROM v_changes JOIN v_races USING (race_id)")
def hydrate(r):
    inline = r.changes.select("change_id", "race_id", F.when(F.col("change_id") % 2 == 0, "").otherwise("XX").alias("track_code"))
    return joins.hydrate(inline, r.races, "race_id", "track_code").select("change_id", "track_code")


@query("v_changes", "v_entries", "v_horses", sql="""
  , e AS (SELECT race_id, entry_id, program_number, lower(regexp_replace(horse_name, '[^A-Za-z0-9]', '', 'g')) AS nm FROM v_entries JOIN v_horses USING (horse_id)),
  p AS (SELECT race_id, program_number, min(entry_id) AS id FROM e GROUP BY 1, 2), q AS (SELECT race_id, nm, min(entry_id) AS id FROM e GROUP BY 1, 2),
  c AS (SELECT c.change_id, c.race_id, c.program_number, CASE WHEN c.change_id % 2 = 0 THEN lower(regexp_replace(h.horse_name, '[^A-Za-z0-9]', '', 'g')) END AS nm
        FROM v_changes c LEFT JOIN v_entries x ON x.entry_id = c.race_id * 10 + 1 LEFT JOIN v_horses h ON h.horse_id = x.horse_id)
  SELECT c.change_id, coalesce(p.id, q.id) AS entry_id FROM c LEFT JOIN p ON p.race_id = c.race_id AND p.program_number = c.program_number LEFT JOIN q ON q.race_id = c.race_id AND q.nm = c.nm
  WHERE coalesce(p.id, q.id) IS NOT NULL OR (c.program_number IS NULL AND c.nm IS NULL)""")
def match_entry_two_stage(r):
    named = r.entries.join(r.horses, "horse_id")
    first = named.select((F.col("entry_id") - 1).alias("_e"), "horse_name")
    c = r.changes.drop("entry_id").withColumn("_e", F.col("race_id") * 10).join(first, "_e", "left").withColumn("horse_name", F.when(F.col("change_id") % 2 == 0, F.col("horse_name")))
    return joins.match_entries(c, named).select("change_id", "entry_id")


@query("v_claims", "v_entries", "v_horses", sql="""
  , e AS (SELECT race_id, entry_id, lower(regexp_replace(horse_name, '[^A-Za-z0-9]', '', 'g')) AS nm FROM v_entries JOIN v_horses USING (horse_id)),
  c AS (SELECT race_id, claim_id, lower(regexp_replace(horse_name, '[^A-Za-z0-9]', '', 'g')) AS nm FROM v_claims JOIN v_horses USING (horse_id))
  SELECT claim_id, entry_id FROM c JOIN e USING (race_id, nm)""")
def match_name_in_race(r):
    return joins.match_name_in_race(r.claims.join(r.horses, "horse_id").select("race_id", "claim_id", "horse_name"), r.entries.join(r.horses, "horse_id").select("race_id", "entry_id", "horse_name")).select("claim_id", "entry_id")


@query("v_entries", "v_horses", sql="""
  , e AS (SELECT race_id, entry_id, lower(regexp_replace(horse_name, '[^A-Za-z0-9]', '', 'g')) AS nm FROM v_entries JOIN v_horses USING (horse_id)),
  s AS (SELECT race_id, left(h.horse_name, 4 + cast(race_id % 5 as int)) AS scratched_name, lower(regexp_replace(left(h.horse_name, 4 + cast(race_id % 5 as int)), '[^A-Za-z0-9]', '', 'g')) AS sn FROM v_entries x JOIN v_horses h USING (horse_id) WHERE program_number = '1'),
  m AS (SELECT s.race_id, scratched_name, entry_id, row_number() OVER (PARTITION BY s.race_id, scratched_name ORDER BY CASE WHEN sn = nm THEN 0 ELSE 1 END, entry_id) AS n
        FROM s JOIN e ON s.race_id = e.race_id AND (sn = nm OR (length(sn) >= 4 AND contains(nm, sn))) WHERE length(sn) >= 3)
  SELECT race_id, scratched_name, entry_id FROM m WHERE n = 1""")
def match_scratch_names(r):
    named = r.entries.join(r.horses, "horse_id")
    said = named.where("program_number = '1'").select("race_id", F.left("horse_name", (F.lit(4) + F.col("race_id") % 5).cast("int")).alias("scratched_name"))
    return joins.match_scratch_names(said, named).select("race_id", "scratched_name", "entry_id")


@query("v_exotics", sql="SELECT race_id, cast(arg_min(payout, seq) AS DOUBLE) AS exotic_payout FROM v_exotics WHERE lower(wager_type) LIKE '%trifecta%' GROUP BY 1")
def lookup_exotic(r):
    return joins.first_exotic(r.exotics, "trifecta").select("race_id", _d("exotic_payout"))


@query("v_tracks", "v_races", sql=f"""
  SELECT track_code, CASE WHEN a IS NULL THEN NULL ELSE DATE '{AS_OF_DATE}' BETWEEN a AND b END AS has_card
  FROM v_tracks LEFT JOIN (SELECT track_code, min(race_date) AS a, max(race_date) AS b FROM v_races WHERE track_code < 'T12' AND race_date < DATE '1998-06-02' GROUP BY 1) USING (track_code)""")
def schedule_join(r):
    s = r.races.where("track_code < 'T12' AND race_date < DATE '1998-06-02'").groupBy("track_code").agg(F.min("race_date").alias("start_date"), F.max("race_date").alias("end_date"))
    return joins.schedule_join(r.tracks.select("track_code"), s, AS_OF_DATE)


@query("v_tracks", "v_races", sql=f"SELECT track_code, count(race_id) AS total FROM v_tracks LEFT JOIN (SELECT * FROM v_races WHERE race_date = DATE '{AS_OF_DATE}') USING (track_code) GROUP BY 1")
def count_default_join(r):
    return joins.count_default(r.tracks.select("track_code"), r.races.where(F.col("race_date") == F.lit(AS_OF_DATE).cast("date")).groupBy("track_code").agg(F.count("*").alias("total")))


@query("v_horses", sql="""
  , q AS (SELECT horse_name AS request FROM v_horses UNION SELECT split_part(horse_name, ' ', 1) FROM v_horses UNION SELECT 'ED ' UNION SELECT 'g' UNION SELECT 'zzz' UNION SELECT 'qu'),
  a AS (SELECT request, count(*) AS n, min(horse_id) AS h FROM q JOIN v_horses ON trim(lower(request)) = lower(horse_name) GROUP BY 1),
  b AS (SELECT request, count(*) AS n, min(horse_id) AS h FROM q JOIN v_horses ON contains(lower(horse_name), trim(lower(request))) GROUP BY 1)
  SELECT request, CASE WHEN coalesce(a.n, b.n, 0) = 0 THEN 'not_found' WHEN coalesce(a.n, b.n) = 1 THEN 'matched' ELSE 'ambiguous' END AS outcome, coalesce(a.n, b.n, 0) AS matches,
         CASE WHEN coalesce(a.n, b.n) = 1 THEN coalesce(a.h, b.h) END AS horse_id FROM q LEFT JOIN a USING (request) LEFT JOIN b USING (request)""")
def lookup_horse(r):
    n = F.col("horse_name")
    asked = r.horses.select(F.explode(F.array(n, F.split_part(n, F.lit(" "), F.lit(1)))).alias("request")).union(r.spark.createDataFrame([("ED ",), ("g",), ("zzz",), ("qu",)], "request string")).distinct()
    return joins.lookup_horse(asked, r.horses)


# --- aggregations ----------------------------------------------------------------------------

@query("v_entries", sql="SELECT race_id, count(*) AS entry_count, coalesce(string_agg(program_number, '-' ORDER BY finish_position) FILTER (WHERE finish_position <= 3), '') AS results FROM v_entries GROUP BY 1")
def race_stats(r):
    return agg.race_stats(r.entries).select("race_id", "entry_count", F.array_join(F.transform("top3", lambda x: x["program_number"]), "-").alias("results"))


@query("v_entries", "v_races", sql="SELECT race_id, coalesce(winner_program_number, program_number, 'N/A') AS winner_number, horse_id AS winner_horse_id FROM v_races LEFT JOIN (SELECT * FROM v_entries WHERE finish_position = 1) USING (race_id)")
def race_winner(r):
    return agg.race_winner(r.races, r.entries)


_STATE_SQL = f"""
  , st AS (SELECT race_id, count(*) AS entry_count, count(*) FILTER (WHERE finish_position <= 3) AS top, coalesce(string_agg(program_number, '-' ORDER BY finish_position) FILTER (WHERE finish_position <= 3), '') AS results FROM v_entries GROUP BY 1),
  live AS (SELECT r.*, t.track_name, st.entry_count, coalesce(st.results, '') AS results, r.race_id IN (SELECT race_id FROM v_claims) AS has_claims,
    CASE WHEN coalesce(st.top, 0) > 0 OR race_status = 'completed' THEN 'completed' WHEN race_status = 'cancelled' THEN 'cancelled' WHEN race_status = 'past_drf_only' THEN 'past'
         WHEN post_time IS NULL THEN race_status
         WHEN TIMESTAMP '{AS_OF_TS}' >= cast(race_date as timestamp) + cast(post_time as interval) + (CASE timezone WHEN 'America/New_York' THEN INTERVAL 4 HOUR WHEN 'America/Chicago' THEN INTERVAL 5 HOUR WHEN 'America/Denver' THEN INTERVAL 6 HOUR ELSE INTERVAL 7 HOUR END) + INTERVAL 20 MINUTE THEN 'past'
         ELSE 'upcoming' END AS live_status
    FROM v_races r LEFT JOIN v_tracks t USING (track_code) LEFT JOIN st ON st.race_id = r.race_id WHERE race_date = DATE '{AS_OF_DATE}')
"""
_STATE_VIEWS = ("v_races", "v_tracks", "v_entries", "v_claims")


@query(*_STATE_VIEWS, sql=_STATE_SQL + "SELECT race_id, race_key, track_name, live_status, coalesce(entry_count, 0) AS entry_count, results, has_claims, CASE WHEN post_time IS NULL THEN 'N/A' ELSE strftime(cast('2000-01-01 ' || post_time as timestamp), '%-I:%M %p') END AS post_time FROM live")
def todays_races(r):
    return products.todays_races(r, AS_OF_DATE, AS_OF_TS).select("race_id", "race_key", "track_name", "live_status", "entry_count", "results", "has_claims", "post_time")


@query(*_STATE_VIEWS, sql=_STATE_SQL + "SELECT race_id FROM live WHERE live_status = 'completed'")
def filter_status(r):
    return products.todays_races(r, AS_OF_DATE, AS_OF_TS, status="Completed").select("race_id")


@query(*_STATE_VIEWS, "v_horses", sql=_STATE_SQL + """
  , nm AS (SELECT live.*, horse_name AS winner_name FROM live LEFT JOIN (SELECT race_id, horse_id FROM v_entries WHERE finish_position = 1) w USING (race_id) LEFT JOIN v_horses USING (horse_id))
  SELECT track_code, race_date, count(*) AS total, count(*) FILTER (WHERE live_status = 'upcoming') AS upcoming, count(*) FILTER (WHERE live_status = 'past') AS past_post, count(*) FILTER (WHERE live_status = 'completed') AS completed, count(*) FILTER (WHERE is_cancelled) AS cancelled,
         bool_and(is_cancelled) AS fully_cancelled, min(CASE WHEN live_status = 'upcoming' THEN post_time END) AS next_post_time,
         coalesce(arg_max(CASE WHEN live_status = 'completed' THEN coalesce(winner_name, 'Unknown') END, CASE WHEN live_status = 'completed' THEN race_number END), 'Unknown') AS last_winner FROM nm GROUP BY 1, 2""")
def track_day_summary(r):
    return products.day_summary(r, AS_OF_DATE, AS_OF_TS)


@query("v_races", sql=f"SELECT count(*) AS total FROM v_races WHERE race_date = DATE '{AS_OF_DATE}'")
def summary_total(r):
    return agg.summary_total(products.day_summary(r, AS_OF_DATE, AS_OF_TS))


_STARTS_SQL = """, s AS (SELECT e.*, r.race_key, r.race_date, r.track_code, r.race_number FROM v_entries e JOIN v_races r ON r.race_id = e.race_id WHERE r.race_status = 'completed' AND NOT e.scratched),
  hs AS (SELECT horse_id, count(*) AS starts, count(*) FILTER (WHERE finish_position = 1) AS wins, count(*) FILTER (WHERE finish_position = 2) AS places, count(*) FILTER (WHERE finish_position = 3) AS shows, max(race_date) AS last_race_date,
         arg_max(track_code, struct_pack(a := race_date, b := race_number, c := track_code)) AS last_track,
         cast(sum(CASE finish_position WHEN 1 THEN win_payout WHEN 2 THEN place_payout WHEN 3 THEN show_payout ELSE 0 END) as double) AS earnings FROM s GROUP BY 1)
"""


@query("v_entries", "v_races", sql=_STARTS_SQL + "SELECT horse_id, starts, wins, places, shows, last_race_date, last_track, round_even(wins * 100.0 / starts, 1) AS win_pct FROM hs")
def horse_stats(r):
    return agg.horse_stats(products._starts(r)).withColumn("win_pct", F.col("win_pct").cast("double"))


@query("v_entries", "v_races", sql=_STARTS_SQL + "SELECT horse_id, starts, earnings FROM hs")
def horse_profile_stats(r):
    return agg.horse_profile_stats(products._starts(r)).select("horse_id", "starts", _d("earnings"))


@query("v_entries", "v_races", "v_horses", sql=_STARTS_SQL + "SELECT horse_id, horse_name, coalesce(starts, 0) AS starts, coalesce(wins, 0) AS wins FROM v_horses LEFT JOIN hs USING (horse_id) WHERE length(horse_name) >= 2 AND horse_name ILIKE '%b%'")
def horses(r):
    return products.horses(r, "b").select("horse_id", "horse_name", "starts", "wins")


@query("v_entries", "v_races", "v_horses", sql="SELECT e.horse_id, e.entry_id, race_key, race_date, coalesce(cast(finish_position as varchar), 'N/A') AS finish FROM v_entries e JOIN v_races r ON r.race_id = e.race_id WHERE e.horse_id IN (SELECT horse_id FROM v_horses)")
def horse_history(r):
    return products.horse_history(r, r.horses).select("horse_id", "entry_id", "race_key", "race_date", "finish")


@query("v_claims", sql="""
  SELECT count(*) AS total, count(*) FILTER (WHERE coalesce(new_trainer_name, '') <> '' AND coalesce(new_owner_name, '') <> '') AS complete, count(*) FILTER (WHERE NOT (coalesce(new_trainer_name, '') <> '' AND coalesce(new_owner_name, '') <> '')) AS missing,
         round_even(count(*) FILTER (WHERE coalesce(new_trainer_name, '') <> '' AND coalesce(new_owner_name, '') <> '') * 100.0 / count(*), 1) AS coverage_pct, bool_and(coalesce(new_trainer_name, '') <> '' AND coalesce(new_owner_name, '') <> '') AS all_complete FROM v_claims""")
def claims_coverage(r):
    return agg.claims_coverage(r.claims).withColumn("coverage_pct", F.col("coverage_pct").cast("double"))


@query("v_claims", "v_races", sql="""
  SELECT claim_id, race_key, race_date, coalesce(new_trainer_name, 'N/A') AS new_trainer_name, coalesce(nullif(new_owner_name, ''), 'N/A') AS new_owner_name, cast(claim_price as double) AS claim_price,
         coalesce(new_trainer_name, '') <> '' AND coalesce(new_owner_name, '') <> '' AS claimant_details_complete FROM v_claims JOIN v_races USING (race_id)""")
def claims_feed(r):
    return products.claims_feed(r).select("claim_id", "race_key", "race_date", "new_trainer_name", "new_owner_name", _d("claim_price"), "claimant_details_complete")


@query("v_races", sql=f"SELECT DISTINCT race_date FROM v_races WHERE race_date <= DATE '{AS_OF_DATE}'")
def distinct_dates(r):
    return products.filter_options(r, AS_OF_DATE)[0]


@query("v_tracks", sql="SELECT track_code, CASE track_code WHEN 'T03' THEN 'Pinned' ELSE track_name END AS track_name FROM v_tracks UNION ALL SELECT 'WO', 'Woodbine'")
def distinct_tracks(r):
    return agg.distinct_tracks(r.tracks, {"T03": "Pinned", "WO": "Woodbine"})


_VERIFIED_SQL = ", s AS (SELECT race_id, race_status, count(*) FILTER (WHERE finish_position > 0) AS finishers, coalesce(bool_or(finish_position = 1), false) AS has_winner FROM v_races LEFT JOIN v_entries USING (race_id) GROUP BY 1, 2) "


@query("v_races", "v_entries", sql=_VERIFIED_SQL + "SELECT race_id, finishers, has_winner, race_status = 'completed' AND has_winner AND finishers >= 3 AS verified FROM s")
def verified_races(r):
    return agg.verified_races(r.races, r.entries)


@query("v_races", "v_entries", sql=_VERIFIED_SQL + "SELECT race_id FROM s WHERE race_status = 'completed' AND finishers < 3 OR race_status = 'past_drf_only'")
def unresolved_races(r):
    seen = agg.verified_races(r.races, r.entries).join(r.races.select("race_id", "race_status"), "race_id")
    return seen.where("race_status = 'completed' AND finishers < 3 OR race_status = 'past_drf_only'").select("race_id")


@query("v_races", "v_entries", sql=_VERIFIED_SQL + "SELECT race_id, CASE WHEN race_status = 'completed' AND has_winner AND finishers >= 3 THEN 'verified_skip' WHEN has_winner THEN 'few_finishers' ELSE 'no_winner' END AS reason FROM s")
def recrawl_reason(r):
    return agg.recrawl_reason(agg.verified_races(r.races, r.entries))


@query("v_crawl_events", sql="SELECT feed, source, count(*) AS requested, count(*) FILTER (WHERE kind = 'success') AS succeeded, count(*) FILTER (WHERE kind = 'failure') AS failed, count(*) FILTER (WHERE kind = 'signal') AS signalled FROM v_crawl_events GROUP BY 1, 2")
def crawl_stats(r):
    return agg.run_stats(r.crawl_events, "feed", "source")


@query("v_crawl_events", sql="SELECT feed, cast(count(*) as bigint) AS requested, cast(count(*) FILTER (WHERE kind = 'success') as bigint) AS succeeded, cast(count(*) FILTER (WHERE kind = 'failure') as bigint) AS failed, cast(count(*) FILTER (WHERE kind = 'signal') as bigint) AS signalled FROM v_crawl_events GROUP BY 1")
def merge_run_stats(r):
    e = r.crawl_events
    return agg.merge_run_stats(agg.run_stats(e.where("event_id % 2 = 0"), "feed"), agg.run_stats(e.where("event_id % 2 = 1"), "feed"))


@query("v_crawl_events", sql="SELECT source, count(*) AS rows FROM v_crawl_events GROUP BY 1")
def source_contributions(r):
    return agg.source_contributions(r.crawl_events)


@query("v_crawl_events", sql="SELECT source, count(*) AS attempts, count(*) FILTER (WHERE kind = 'success') AS successes FROM v_crawl_events GROUP BY 1")
def fetch_telemetry(r):
    return agg.fetch_telemetry(r.crawl_events)


@query("v_races", "v_entries", sql="""
  , c AS (SELECT race_id, 0 AS variant, count(*) FILTER (WHERE scratched) AS size FROM v_entries GROUP BY 1 UNION ALL SELECT race_id, 1, count(*) FILTER (WHERE NOT scratched) FROM v_entries GROUP BY 1)
  SELECT race_id, variant, size FROM (SELECT *, row_number() OVER (PARTITION BY race_id ORDER BY size DESC, variant) AS n FROM c) WHERE n = 1""")
def largest_candidate(r):
    e = r.entries.groupBy("race_id").agg(F.count_if("scratched").alias("a"), F.count_if(~F.col("scratched")).alias("b"))
    both = e.select("race_id", F.lit(0).alias("variant"), F.col("a").alias("size")).union(e.select("race_id", F.lit(1), F.col("b")))
    return agg.largest_candidate(both, "race_id")


@query("v_entries", "v_races", sql=f"""
  SELECT coalesce(bool_or(race_date >= DATE '{AS_OF_DATE}'), false) AS has_entries, coalesce(bool_or(race_date <= DATE '{AS_OF_DATE}' AND finish_position <= 3), false) AS has_results,
         coalesce(bool_or(race_date <= DATE '{AS_OF_DATE}' AND scratched), false) AS has_scratches FROM v_entries JOIN v_races USING (race_id) WHERE race_date BETWEEN DATE '1998-05-31' AND DATE '1998-06-03'""")
def recent_activity_probe(r):
    return agg.activity_probe(r.entries, r.races, AS_OF_DATE)


# --- windows, orders, sets -------------------------------------------------------------------

@query("v_races", sql="SELECT race_id, lag(race_key) OVER w AS prev_race_key, lead(race_key) OVER w AS next_race_key FROM v_races WINDOW w AS (PARTITION BY track_code, race_date ORDER BY race_number)")
def prev_next_race(r):
    return dedupe.prev_next_race(r.races).select("race_id", "prev_race_key", "next_race_key")


@query("v_entries", sql="SELECT race_id, finish_position, program_number FROM v_entries WHERE finish_position BETWEEN 1 AND 3")
def top3_per_race(r):
    return dedupe.top_finishers(r.entries).select("race_id", "finish_position", "program_number")


@query("v_entries", "v_horses", sql="SELECT race_id, entry_id FROM (SELECT race_id, entry_id, row_number() OVER (PARTITION BY race_id, upper(horse_name) ORDER BY finish_position IS NULL, entry_id) AS n FROM v_entries JOIN v_horses USING (horse_id)) WHERE n = 1")
def dedupe_entries_by_horse(r):
    return dedupe.dedupe_entries_by_horse(r.entries.join(r.horses, "horse_id")).select("race_id", "entry_id")


@query("v_changes", sql="""SELECT * FROM (WITH RECURSIVE
    n AS (SELECT race_id, entry_id, change_type, coalesce(description, '') AS said, row_number() OVER w AS k, count(*) OVER (PARTITION BY race_id, entry_id, change_type) AS last FROM v_changes WINDOW w AS (PARTITION BY race_id, entry_id, change_type ORDER BY change_id)),
    t AS (SELECT race_id, entry_id, change_type, k, last, said AS text FROM n WHERE k = 1
          UNION ALL SELECT n.race_id, n.entry_id, n.change_type, n.k, n.last,
            CASE WHEN said = '' OR contains(lower(text), lower(said)) THEN text WHEN text = '' THEN said WHEN contains(lower(text), 'reason unavailable') AND NOT contains(lower(said), 'reason unavailable') THEN said
                 WHEN contains(lower(said), 'reason unavailable') THEN text ELSE text || '; ' || said END
          FROM t JOIN n ON n.race_id = t.race_id AND n.entry_id IS NOT DISTINCT FROM t.entry_id AND n.change_type = t.change_type AND n.k = t.k + 1)
  SELECT race_id, entry_id, change_type, CASE WHEN length(text) > 500 THEN left(text, 497) || '...' ELSE text END AS description FROM t WHERE k = last)""")
def merge_change_descriptions(r):
    return dedupe.merge_descriptions(r.changes.withColumn("seq", F.col("change_id")))


@query("v_tracks", "v_races", sql="SELECT track_code, min(race_id) AS pos FROM v_races GROUP BY 1")
def dedupe_ordered(r):
    return dedupe.dedupe_ordered(r.races.select(F.concat(F.lit(" "), F.lower("track_code")).alias("track_code"), F.col("race_id").alias("pos")))


@query("v_entries", "v_races", sql="""
  , p AS (SELECT track_code, race_status, CASE race_status WHEN 'completed' THEN 1 WHEN 'cancelled' THEN 2 ELSE 3 END AS priority, race_id FROM v_races)
  SELECT track_code, race_id FROM p WHERE priority = (SELECT min(priority) FROM p q WHERE q.track_code = p.track_code)""")
def first_non_empty_source(r):
    rows = r.races.withColumn("priority", F.when(F.col("race_status") == "completed", 1).when(F.col("race_status") == "cancelled", 2).otherwise(3))
    return dedupe.first_non_empty_source(rows).select("track_code", "race_id")


@query("v_crawl_events", sql="""
  , m AS (SELECT *, kind = 'failure' AS bad, sum(CASE WHEN kind = 'failure' THEN 0 ELSE 1 END) OVER (PARTITION BY feed ORDER BY event_id) AS island FROM v_crawl_events)
  SELECT event_id, feed, cast(sum(CASE WHEN bad THEN 1 ELSE 0 END) OVER (PARTITION BY feed, island ORDER BY event_id) as bigint) AS run FROM m""")
def consecutive_run(r):
    states = r.crawl_events.withColumn("bad", F.col("kind") == "failure")
    thousand = F.floor(F.col("event_id") / 1000)
    return dedupe.consecutive_runs(states, ("feed",), "event_id", "bad", thousand).select("event_id", "feed", F.col("run").cast("long").alias("run"))


@query("v_races", sql="SELECT race_id, race_key FROM v_races ORDER BY race_date DESC, race_number, race_id LIMIT 100")
def top_k_races(r):
    return ordering.sort_by(r.races, [("race_date", True), ("race_number", False), ("race_id", False)]).limit(ordering.clamp(100, 200)).select("race_id", "race_key")


@query("v_races", sql="SELECT race_id, (SELECT count(*) FROM v_races) AS total, cast(ceil((SELECT count(*) FROM v_races) / 20.0) as int) AS pages, (SELECT count(*) FROM v_races) > 60 AS more FROM v_races ORDER BY race_date DESC, race_id LIMIT 20 OFFSET 40")
def paginate(r):
    rows, total, pages, more = ordering.paginate(r.races, [F.desc("race_date"), "race_id"], 3, 20)
    return rows.select("race_id", F.lit(total).cast("long").alias("total"), F.lit(pages).alias("pages"), F.lit(more).alias("more"))


@query("v_races", sql="SELECT race_id, cast(floor((row_number() OVER (ORDER BY race_date, race_id) - 1) / 50) + 1 as bigint) AS page FROM v_races")
def page_export(r):
    return ordering.page_export(r.races.select("race_date", "race_id"), ["race_date", "race_id"], 50).select("race_id", "page")


@query("v_races", sql="SELECT track_code FROM v_races WHERE race_status = 'cancelled' EXCEPT SELECT track_code FROM v_races WHERE race_date = DATE '1998-06-01' AND race_status = 'upcoming'")
def except_tracks(r):
    return sets.except_tracks(r.races.where("race_status = 'cancelled'"), r.races.where("race_date = DATE '1998-06-01' AND race_status = 'upcoming'"))


@query("v_races", sql="SELECT track_code FROM v_races WHERE race_date = DATE '1998-06-01' INTERSECT SELECT track_code FROM v_races WHERE surface = 'Turf' AND race_status = 'upcoming'")
def intersect_tracks(r):
    return sets.intersect_tracks(r.races.where("race_date = DATE '1998-06-01'"), r.races.where("surface = 'Turf' AND race_status = 'upcoming'"))


@query("v_races", "v_tracks", sql="SELECT track_code FROM v_tracks UNION SELECT track_code FROM v_races")
def union_distinct_tracks(r):
    return sets.union_distinct_tracks(r.tracks, r.races)


@query("v_races", sql="SELECT race_id FROM v_races WHERE race_date BETWEEN DATE '1998-05-31' AND DATE '1998-07-02'")
def union_days(r):
    return sets.union_days(r.races, AS_OF_DATE, 1, 31).select("race_id")


@query(*_FEED_VIEWS, sql=_FEED_SQL + "SELECT change_id, race_id, entry_id, program_number, change_type, description, change_time, source_rank FROM f")
def union_change_sources(r):
    return sets.union_change_sources(r.changes, joins.anti_detailed_scratch(r.entries, r.changes))


@query("v_crawl_events", sql="SELECT event_id, feed, kind, seen_at, source FROM v_crawl_events")
def union_feeds(r):
    parts = {s: r.crawl_events.where(F.col("source") == s).drop("source") for s in ("rss", "direct", "mobile", "index")}
    return sets.union_feeds(**parts).select("event_id", "feed", "kind", "seen_at", "source")


# --- scalar functions ------------------------------------------------------------------------

@query("v_horses", sql="""
  SELECT horse_id, lower(regexp_replace(regexp_replace(horse_name || ' (IRE) #' || horse_id, '\\([^)]*\\)', '', 'g'), '[^A-Za-z0-9]', '', 'g')) AS norm, upper(horse_name) AS upper_name,
         coalesce(nullif(ltrim(upper(regexp_replace('0' || (horse_id % 12) || 'a-', '[^A-Za-z0-9]', '', 'g')), '0'), ''), '0') AS pgm, horse_name AS clean_name FROM v_horses""")
def name_functions(r):
    n = F.col("horse_name")
    return r.horses.select(
        "horse_id", names.normalize_name(F.concat(n, F.lit(" (IRE) #"), F.col("horse_id").cast("string"))).alias("norm"), names.normalize_horse_name(F.concat(F.lit("  "), n, F.lit(" "))).alias("upper_name"),
        names.normalize_pgm(F.concat(F.lit("0"), (F.col("horse_id") % 12).cast("string"), F.lit("a-"))).alias("pgm"), names.clean_horse_name(F.concat(n, F.lit(" (97)"))).alias("clean_name"),
    )


@query("v_races", sql="""
  SELECT race_id, CASE race_id % 5 WHEN 0 THEN '6 Furlongs' WHEN 1 THEN '1 1/8 Miles' WHEN 2 THEN '350 Yards' WHEN 3 THEN '1 Mile' ELSE '7 Furlongs' END AS label, CASE race_id % 5 WHEN 0 THEN 3960 WHEN 1 THEN 5940 WHEN 2 THEN 1050 WHEN 3 THEN 5280 ELSE 4620 END AS feet FROM v_races""")
def parse_distance(r):
    return r.races.select("race_id", racing.parse_distance(F.col("distance")).alias("d")).select("race_id", "d.label", "d.feet")


@query("v_races", sql="SELECT race_id, track_code || '-' || strftime(race_date, '%Y%m%d') || '-' || race_number AS key, 'x/' || track_code || strftime(race_date, '%m%d%y') || 'USA' || race_number || '.pdf' AS url FROM v_races")
def keys_and_urls(r):
    k = (F.col("track_code"), F.col("race_date"), F.col("race_number"))
    return r.races.select("race_id", racing.race_key(*k).alias("key"), racing.chart_url("x/", *k).alias("url"))


@query("v_races", sql="SELECT race_id, CASE race_id % 4 WHEN 0 THEN (race_id % 9) || '-1' WHEN 1 THEN (race_id % 9) || '-2' WHEN 2 THEN (race_id % 9) || '-5' END AS odds FROM v_races")
def parse_odds(r):
    k, n = F.col("race_id") % 4, (F.col("race_id") % 9).cast("string")
    raw = F.when(k == 0, n).when(k == 1, F.concat(n, F.lit("/2"))).when(k == 2, F.concat(n, F.lit("-5")))
    return r.races.select("race_id", racing.parse_odds(raw).alias("odds"))


@query("v_races", sql="SELECT race_id, CASE WHEN post_time IS NULL THEN NULL ELSE strftime(cast('2000-01-01 ' || post_time as timestamp), '%-I:%M %p') END AS t FROM v_races")
def format_12h(r):
    return r.races.select("race_id", times.format_12h(F.col("post_time")).alias("t"))


@query("v_changes", sql="SELECT change_id, nullif(upper(regexp_extract(description, '(?i)changed to\\s+(\\d{1,2}:\\d{2}\\s*(AM|PM)?)', 1)), '') AS t FROM v_changes")
def extract_new_post_time(r):
    return r.changes.select("change_id", ch.extract_new_post_time(F.col("description")).alias("t"))


@query("v_changes", sql="""
  SELECT change_id, CASE WHEN contains(lower(description), 'scratched') THEN 'Scratch' WHEN contains(lower(description), 'jockey') THEN 'Jockey Change' WHEN contains(lower(description), 'cancel') THEN
    CASE WHEN NOT regexp_matches(lower(description), 'wagering|simulcast|pool|turf racing|superfecta|trifecta|exacta|daily double|pick|quinella|win|place|show|omnibus') THEN 'Race Cancelled' WHEN regexp_matches(lower(description), 'wagering|pool') THEN 'Wagering' ELSE 'Other' END
    ELSE 'Other' END AS kind FROM v_changes""")
def change_type(r):
    return r.changes.select("change_id", ch.change_type(F.col("description")).alias("kind"))


@query("v_changes", sql="SELECT change_id, CASE WHEN description = '' THEN '- Y' ELSE description END AS text FROM v_changes")
def normalize_change_description(r):
    d = F.col("description")
    return r.changes.select("change_id", ch.normalize_change_description(F.concat(d, F.lit(" ;  "), F.upper(d), F.lit(" - Y; "))).alias("text"))


@query("v_bets", sql="SELECT n, n * (n - 1) AS p2, n * (n - 1) * (n - 2) AS p3 FROM (SELECT bet_id % 9 AS n FROM v_bets)")
def permutations(r):
    n = F.col("n")
    return r.bets.select((F.col("bet_id") % 9).alias("n")).select("n", money.perm2(n).alias("p2"), money.perm3(n).alias("p3"))


# --- bets ------------------------------------------------------------------------------------

_COST_SQL = """, b0 AS (SELECT *, CASE WHEN bet_type IN ('Exacta Box', 'Trifecta Box') THEN from_json(selection, '["VARCHAR"]') END AS picks, CASE WHEN bet_type IN ('Exacta Key', 'Trifecta') THEN from_json(selection, '[["VARCHAR"]]') END AS pos FROM v_bets),
  b AS (SELECT *, cast(bet_amount * CASE bet_type WHEN 'Exacta Box' THEN len(picks) * (len(picks) - 1) WHEN 'Trifecta Box' THEN len(picks) * (len(picks) - 1) * (len(picks) - 2) WHEN 'WPS' THEN 3 WHEN 'Win Place' THEN 2 WHEN 'Place Show' THEN 2
        WHEN 'Exacta Key' THEN len(pos[1]) * len(pos[2]) - len(list_filter(pos[1], lambda x: list_contains(pos[2], x))) ELSE 1 END as decimal(12,2)) AS bet_cost FROM b0)
"""


@query("v_bets", sql=_COST_SQL + "SELECT bet_id, cast(bet_cost as double) AS bet_cost FROM b")
def bet_cost(r):
    return betting.bet_cost(r.bets).select("bet_id", _d("bet_cost"))


_SETTLE_SQL = _COST_SQL + f""", fin AS (SELECT race_id, list(program_number ORDER BY finish_position) AS f FROM v_entries WHERE finish_position IS NOT NULL GROUP BY 1),
  ex AS (SELECT race_id, arg_min(payout, seq) AS p FROM v_exotics WHERE lower(wager_type) LIKE '%exacta%' GROUP BY 1), tr AS (SELECT race_id, arg_min(payout, seq) AS p FROM v_exotics WHERE lower(wager_type) LIKE '%trifecta%' GROUP BY 1),
  j AS (SELECT b.*, r.race_status, r.race_date, coalesce(e.scratched, false) AS sc, e.finish_position AS fp, coalesce(e.win_payout, 0) AS wp, coalesce(e.place_payout, 0) AS pp, coalesce(e.show_payout, 0) AS sp, coalesce(fin.f, []) AS f, coalesce(ex.p, 0) AS exp, coalesce(tr.p, 0) AS trp,
        bet_type IN ('Win','Place','Show','WPS','Win Place','Place Show') AS single
        FROM b JOIN v_races r ON r.race_id = b.race_id LEFT JOIN v_entries e ON e.race_id = b.race_id AND e.program_number = b.horse_number LEFT JOIN fin ON fin.race_id = b.race_id LEFT JOIN ex ON ex.race_id = b.race_id LEFT JOIN tr ON tr.race_id = b.race_id),
  l AS (SELECT *, CASE WHEN fp = 1 THEN wp * bet_amount * 0.5 ELSE 0 END AS w, CASE WHEN fp <= 2 THEN pp * bet_amount * 0.5 ELSE 0 END AS p, CASE WHEN fp <= 3 THEN sp * bet_amount * 0.5 ELSE 0 END AS s FROM j),
  m AS (SELECT *, CASE bet_type WHEN 'Win' THEN w WHEN 'Place' THEN p WHEN 'Show' THEN s WHEN 'Win Place' THEN w + p WHEN 'Place Show' THEN p + s WHEN 'WPS' THEN w + p + s ELSE 0 END AS earned,
        coalesce(CASE bet_type WHEN 'Win' THEN fp = 1 WHEN 'Place' THEN fp <= 2 WHEN 'Show' THEN fp <= 3
             WHEN 'Exacta Box' THEN len(f) >= 2 AND list_contains(picks, f[1]) AND list_contains(picks, f[2]) WHEN 'Trifecta Box' THEN len(f) >= 3 AND list_contains(picks, f[1]) AND list_contains(picks, f[2]) AND list_contains(picks, f[3])
             WHEN 'Exacta Key' THEN len(f) >= 2 AND list_contains(pos[1], f[1]) AND list_contains(pos[2], f[2]) WHEN 'Trifecta' THEN len(f) >= 3 AND list_contains(pos[1], f[1]) AND list_contains(pos[2], f[2]) AND list_contains(pos[3], f[3]) END, false) AS hit FROM l),
  z AS (SELECT bet_id, wallet_id, bet_type, bet_cost, CASE WHEN single AND sc THEN 'Returned' WHEN race_status = 'completed' AND CASE WHEN bet_type IN ('WPS','Win Place','Place Show') THEN earned > 0 ELSE hit END THEN 'Win' WHEN race_status = 'completed' THEN 'Loss'
        WHEN race_date <= DATE '{AS_OF_DATE}' - 2 AND race_status = 'cancelled' THEN 'Returned' WHEN race_date <= DATE '{AS_OF_DATE}' - 2 THEN 'Loss' ELSE 'Pending' END AS new_status, CASE WHEN single THEN earned WHEN bet_type LIKE 'Exacta%' THEN exp * bet_amount * 0.5 ELSE trp * bet_amount * 0.5 END AS pay FROM m),
  settled AS (SELECT bet_id, wallet_id, bet_type, bet_cost, new_status, cast(cast(CASE new_status WHEN 'Returned' THEN bet_cost WHEN 'Win' THEN pay ELSE 0 END as decimal(14,2)) as double) AS payout FROM z)
"""
_BET_VIEWS = ("v_bets", "v_races", "v_entries", "v_exotics")


@query(*_BET_VIEWS, sql=_SETTLE_SQL + "SELECT bet_id, bet_type, new_status, payout FROM settled")
def settle_bets(r):
    return products.settle_bets(r, AS_OF_DATE).select("bet_id", "bet_type", "new_status", _d("payout"))


@query(*_BET_VIEWS, sql=_SETTLE_SQL + """
  , g AS (SELECT count(*) AS n, count(*) FILTER (WHERE new_status = 'Win') AS wins, round(cast(sum(bet_cost) as double), 2) AS wagered, round(sum(payout), 2) AS paid FROM settled WHERE new_status NOT IN ('Pending', 'Returned'))
  SELECT n, wins, cast(round(wins * 100 / n, 0) as int) AS win_rate, wagered, paid, round(paid - wagered, 2) AS profit, round((paid - wagered) * 100 / wagered, 1) AS roi_pct FROM g""")
def bet_stats(r):
    done = products.settle_bets(r, AS_OF_DATE).select(F.col("new_status").alias("status"), "payout", "bet_cost", F.lit(0).cast("decimal(10,2)").alias("bet_amount"))
    return agg.bet_stats(done).select("n", "wins", "win_rate", _d("wagered"), _d("paid"), _d("profit"), "roi_pct")


@query(*_BET_VIEWS, sql=_SETTLE_SQL + "SELECT round(sum(payout), 2) AS earned FROM settled WHERE new_status = 'Win'")
def new_earnings(r):
    after = products.settle_bets(r, AS_OF_DATE).select("bet_id", F.col("new_status").alias("status"), "payout")
    return agg.new_earnings(r.bets, after).select(_d("earned"))


_LEDGER_SQL = _SETTLE_SQL + """, ledger AS (SELECT wallet_id, bet_id AS reference_id, 'Bet' AS transaction_type, -cast(bet_cost as double) AS amount FROM b
  UNION ALL SELECT wallet_id, bet_id, CASE new_status WHEN 'Win' THEN 'Payout' ELSE 'Refund' END, payout FROM settled WHERE new_status IN ('Win', 'Returned') AND payout > 0)
"""


@query(*_BET_VIEWS, sql=_LEDGER_SQL + "SELECT * FROM ledger")
def ledger_entries(r):
    return betting.ledger_entries(r.bets, products.settle_bets(r, AS_OF_DATE)).select("wallet_id", "reference_id", "transaction_type", _d("amount"))


@query(*_BET_VIEWS, sql=_LEDGER_SQL + "SELECT wallet_id, round(1000 + sum(amount), 2) AS balance FROM ledger GROUP BY 1")
def wallet_balance(r):
    return agg.wallet_balance(betting.ledger_entries(r.bets, products.settle_bets(r, AS_OF_DATE))).select("wallet_id", _d("balance"))


@query("v_bets", sql=_COST_SQL + "SELECT cast(sum(bet_cost) as double) AS refund FROM b WHERE status = 'Pending'")
def pending_refund_total(r):
    return agg.pending_refund_total(betting.bet_cost(r.bets)).select(_d("refund"))


@query("v_bets", sql=_COST_SQL + "SELECT wallet_id, bet_id AS reference_id, 'Refund' AS transaction_type, cast(bet_cost as double) AS amount FROM b WHERE bet_id % 5 = 0")
def refund_deleted(r):
    return betting.refund_deleted(r.bets, r.bets.where("bet_id % 5 = 0")).select("wallet_id", "reference_id", "transaction_type", _d("amount"))


@query("v_bets", sql=_COST_SQL + """SELECT * FROM (WITH RECURSIVE
    n AS (SELECT bet_id, wallet_id, bet_cost, row_number() OVER (PARTITION BY wallet_id ORDER BY created_at, bet_id) AS k FROM b),
    t AS (SELECT bet_id, wallet_id, k, CASE WHEN bet_cost > 100 THEN 100 ELSE 100 - bet_cost END AS funds, bet_cost > 100 AS refused FROM n WHERE k = 1
          UNION ALL SELECT n.bet_id, n.wallet_id, n.k, CASE WHEN n.bet_cost > t.funds THEN t.funds ELSE t.funds - n.bet_cost END, n.bet_cost > t.funds FROM t JOIN n ON n.wallet_id = t.wallet_id AND n.k = t.k + 1)
  SELECT bet_id, CASE WHEN refused THEN 'insufficient_funds' END AS reject_reason FROM t)""")
def validate_bets(r):
    return betting.validate_bets(r.bets, r.races, 100).select("bet_id", "reject_reason")


@query("v_bets", sql="SELECT bet_id FROM v_bets ORDER BY created_at DESC, bet_id DESC LIMIT 50")
def recent_bets(r):
    return products.recent_bets(r).select("bet_id")


# --- products --------------------------------------------------------------------------------

@query("v_races", "v_entries", "v_tracks", "v_horses", sql=f"""
  SELECT r.race_id, race_key, track_name, race_status, coalesce(h.horse_name, 'N/A') AS winner_name, coalesce(winner_program_number, w.program_number, 'N/A') AS winner_number, coalesce(n, 0) AS entry_count, coalesce(res, '') AS results
  FROM v_races r LEFT JOIN v_tracks USING (track_code) LEFT JOIN (SELECT * FROM v_entries WHERE finish_position = 1) w ON w.race_id = r.race_id LEFT JOIN v_horses h ON h.horse_id = w.horse_id
  LEFT JOIN (SELECT race_id, count(*) AS n, string_agg(program_number, '-' ORDER BY finish_position) FILTER (WHERE finish_position <= 3) AS res FROM v_entries GROUP BY 1) s ON s.race_id = r.race_id
  WHERE race_status IN ('completed', 'past_drf_only', 'cancelled') AND race_date <= DATE '{AS_OF_DATE}'""")
def past_races(r):
    return products.past_races(r, AS_OF_DATE).select("race_id", "race_key", "track_name", "race_status", "winner_name", "winner_number", "entry_count", "results")


@query("v_races", "v_entries", "v_exotics", "v_claims", "v_horses", "v_jockeys", sql="""
  , e AS (SELECT race_id, string_agg(program_number || ' ' || coalesce(horse_name, 'Unknown') || ' ' || coalesce(jockey_name, 'N/A') || ' ' || scratched || ' ' || coalesce(cast(finish_position as varchar), '-'), '|' ORDER BY entry_id) AS entries FROM v_entries LEFT JOIN v_horses USING (horse_id) LEFT JOIN v_jockeys USING (jockey_id) GROUP BY 1),
  x AS (SELECT race_id, string_agg(wager_type || ' ' || cast(payout as varchar), '|' ORDER BY seq) AS exotics FROM v_exotics GROUP BY 1),
  c AS (SELECT race_id, string_agg(claim_id || ' ' || cast(claim_price as varchar), '|' ORDER BY claim_id) AS claims FROM v_claims GROUP BY 1)
  SELECT race_id, coalesce(entries, '') AS entries, coalesce(exotics, '') AS exotics, CASE WHEN race_status = 'completed' THEN coalesce(claims, '') ELSE '' END AS claims,
         lag(race_key) OVER (PARTITION BY track_code, race_date ORDER BY race_number) AS prev_race_key FROM v_races r LEFT JOIN e USING (race_id) LEFT JOIN x USING (race_id) LEFT JOIN c USING (race_id)""")
def race_cards(r):
    told = lambda c, *parts: F.array_join(F.transform(c, lambda x: F.concat_ws(" ", *(p(x) for p in parts))), "|").alias(c)
    text = lambda f: lambda x: x[f].cast("string")
    place = lambda x: F.coalesce(x["finish_position"].cast("string"), F.lit("-"))
    return products.race_cards(r, AS_OF_TS).select(
        "race_id", told("entries", text("program_number"), lambda x: x["horse_info"]["horse_name"], text("jockey_name"), text("scratched"), place), told("exotics", text("wager_type"), text("payout")),
        told("claims", text("claim_id"), text("claim_price")), "prev_race_key",
    )


@query("v_races", "v_entries", "v_horses", sql=f"SELECT race_key, entry_id, program_number, horse_name FROM v_entries e JOIN v_races r ON r.race_id = e.race_id JOIN v_horses USING (horse_id) WHERE race_date = DATE '{AS_OF_DATE}' AND NOT scratched")
def entries_for(r):
    return products.entries_for(r, AS_OF_DATE, include_scratched=False).select("race_key", "entry_id", "program_number", F.col("horse_info.horse_name").alias("horse_name"))


@query("v_races", "v_entries", "v_horses", sql=f"SELECT race_key, finish_position, program_number, horse_name, cast(win_payout as double) AS win_payout FROM v_entries e JOIN v_races r ON r.race_id = e.race_id JOIN v_horses USING (horse_id) WHERE race_status = 'completed' AND race_date <= DATE '{AS_OF_DATE}' AND finish_position <= 3")
def results_for(r):
    return products.results_for(r, AS_OF_DATE).select("race_key", "finish_position", "program_number", "horse_name", _d("win_payout"))


# --- streams' batch twins --------------------------------------------------------------------

_FRESH_SQL = f""", a AS (SELECT feed, max(seen_at) AS last_attempt_at, max(CASE WHEN kind = 'success' OR (kind = 'signal' AND feed = 'scratches') THEN seen_at END) AS last_success_at, max(CASE WHEN kind = 'failure' THEN seen_at END) AS last_failure_at
    FROM v_crawl_events WHERE seen_at <= TIMESTAMP '{EVENTS_AS_OF}' GROUP BY 1),
  g AS (SELECT *, cast(floor((floor(epoch(TIMESTAMP '{EVENTS_AS_OF}')) - floor(epoch(last_success_at))) / 60) as bigint) AS age, CASE feed WHEN 'entries' THEN 300 WHEN 'results' THEN 30 ELSE 20 END AS lim, floor((floor(epoch(TIMESTAMP '{EVENTS_AS_OF}')) - floor(epoch(last_attempt_at))) / 60) AS since FROM a),
  h AS (SELECT *, coalesce(age > lim, true) AS late, coalesce(age > lim, true) AND since < 20 AND coalesce(last_failure_at < last_attempt_at, true) AS in_progress FROM g)
"""


@query("v_crawl_events", sql=_FRESH_SQL + "SELECT feed, last_attempt_at, last_success_at, age AS age_minutes, in_progress, late AND NOT in_progress AS stale FROM h")
def feed_freshness(r):
    return health.feed_freshness(r.crawl_events, EVENTS_AS_OF).select("feed", "last_attempt_at", "last_success_at", "age_minutes", "in_progress", "stale")


@query("v_crawl_events", sql=_FRESH_SQL + ", s AS (SELECT CASE WHEN late AND NOT in_progress AND NOT coalesce(last_failure_at = last_attempt_at, false) THEN 'recovering' WHEN late AND NOT in_progress THEN 'attention' WHEN in_progress THEN 'running' ELSE 'ok' END AS p FROM h) SELECT count(*) AS feeds, CASE WHEN count(*) FILTER (WHERE p = 'attention') > 0 THEN 'degraded' WHEN count(*) FILTER (WHERE p = 'recovering') > 0 THEN 'recovering' ELSE 'operational' END AS status FROM s")
def system_health(r):
    return products.system_health(r, EVENTS_AS_OF).select("feeds", "status")


@query("v_crawl_events", sql="""
  , s AS (SELECT *, sum(CASE WHEN kind = 'success' THEN 1 ELSE 0 END) OVER (PARTITION BY feed ORDER BY seen_at, event_id ROWS UNBOUNDED PRECEDING) AS g, cast(floor(epoch(seen_at)) as bigint) AS t FROM v_crawl_events),
  c AS (SELECT event_id, feed, seen_at, count(*) OVER (PARTITION BY feed, g ORDER BY t RANGE BETWEEN 900 PRECEDING AND CURRENT ROW) AS failures FROM s WHERE kind = 'failure') SELECT * FROM c WHERE failures >= 3""")
def failure_burst(r):
    return health.failure_bursts(r.crawl_events)


@query("v_crawl_events", sql="""
  , t AS (SELECT feed, unnest(generate_series(TIMESTAMP '2024-01-05 00:00:00', TIMESTAMP '2024-01-12 00:00:00', INTERVAL 10 MINUTE)) AS evaluated_at FROM (SELECT DISTINCT feed FROM v_crawl_events)),
  good AS (SELECT feed, seen_at FROM v_crawl_events WHERE kind = 'success' OR (kind = 'signal' AND feed = 'scratches')),
  e AS (SELECT t.feed, evaluated_at, coalesce(floor((epoch(evaluated_at) - floor(epoch(seen_at))) / 60) > CASE t.feed WHEN 'entries' THEN 300 WHEN 'results' THEN 30 ELSE 20 END, true) AS stale FROM t ASOF LEFT JOIN good ON t.feed = good.feed AND t.evaluated_at >= good.seen_at),
  i AS (SELECT *, sum(CASE WHEN stale THEN 0 ELSE 1 END) OVER (PARTITION BY feed ORDER BY evaluated_at) AS island FROM e), n AS (SELECT *, row_number() OVER (PARTITION BY feed, island ORDER BY evaluated_at) AS k FROM i WHERE stale)
  SELECT n.feed, n.evaluated_at AS opened_at, f.evaluated_at AS resolved_at, CASE WHEN n.feed = 'entries' THEN 'warning' ELSE 'critical' END AS severity
  FROM n LEFT JOIN (SELECT feed, island - 1 AS island, evaluated_at FROM i WHERE NOT stale) f ON f.feed = n.feed AND f.island = n.island WHERE k = 3""")
def stale_alerts(r):
    return health.stale_alerts(health.stale_evaluations(r.crawl_events, "2024-01-05 00:00:00", "2024-01-12 00:00:00", 10))


@query("v_crawl_events", sql="SELECT count(*) AS events, max(seen_at) AS last_at, arg_max(source, struct_pack(a := seen_at, b := event_id)) AS last_source FROM v_crawl_events WHERE feed = 'scratches' AND kind IN ('signal', 'success')")
def scratch_activity(r):
    return health.scratch_activity(r.crawl_events)


@query("v_entries", "v_changes", sql="""
  , s AS (SELECT DISTINCT entry_id FROM v_changes WHERE change_type = 'Scratch' AND entry_id IS NOT NULL)
  SELECT entry_id, scratched OR entry_id IN (SELECT entry_id FROM s) AS scratched, CASE WHEN entry_id IN (SELECT entry_id FROM s) THEN CASE WHEN scratched THEN 'confirmed' ELSE 'marked' END END AS scratch_effect FROM v_entries""")
def apply_scratch(r):
    return late.apply_scratches(r.entries, r.changes).select("entry_id", "scratched", "scratch_effect")


@query("v_races", "v_changes", "v_entries", sql="""
  , c AS (SELECT race_id, min(description) AS why FROM v_changes WHERE change_type = 'Race Cancelled' AND NOT regexp_matches(lower(description), 'wagering|simulcast|pool|turf racing|superfecta|trifecta|exacta|daily double|pick|quinella|win|place|show|omnibus') GROUP BY 1)
  SELECT race_id, why IS NOT NULL OR is_cancelled AS is_cancelled, CASE WHEN why IS NOT NULL AND race_status <> 'completed' AND race_id NOT IN (SELECT race_id FROM v_entries WHERE finish_position IS NOT NULL) THEN 'cancelled' ELSE race_status END AS race_status FROM v_races LEFT JOIN c USING (race_id)""")
def apply_cancellation(r):
    return late.apply_cancellations(r.races, r.changes, r.entries).select("race_id", "is_cancelled", "race_status")


@query("v_races", "v_changes", sql="""
  , c AS (SELECT race_id, arg_max(description, struct_pack(a := created_at, b := change_id)) AS said FROM v_changes WHERE change_type = 'Post Time Change' GROUP BY 1)
  SELECT race_id, CASE WHEN said IS NOT NULL AND race_status NOT IN ('completed', 'cancelled') THEN 'delayed' ELSE race_status END AS race_status,
         CASE WHEN said IS NOT NULL AND race_status NOT IN ('completed', 'cancelled') THEN upper(regexp_extract(said, 'to (.*)', 1)) ELSE post_time END AS post_time FROM v_races LEFT JOIN c USING (race_id)""")
def apply_delay(r):
    return late.apply_delays(r.races, r.changes).select("race_id", "race_status", "post_time")


@query("v_changes", "v_races", "v_entries", "v_horses", sql="""
  , c AS (SELECT c.race_id AS doc_id, r.race_number, c.description AS d, c.program_number, c.change_id, lower(regexp_replace(h.horse_name, '[^A-Za-z0-9]', '', 'g')) AS horse
          FROM v_changes c JOIN v_races r ON r.race_id = c.race_id LEFT JOIN v_entries e ON e.entry_id = c.entry_id LEFT JOIN v_horses h ON h.horse_id = e.horse_id)
  SELECT doc_id, cast(row_number() OVER (PARTITION BY doc_id ORDER BY change_id) - 1 as int) AS line_no, cast(race_number as int) AS race_number, program_number, CASE WHEN program_number IS NULL THEN '' ELSE coalesce(horse, 'somehorse') END AS horse_name,
    CASE WHEN d LIKE 'Race Cancelled%' THEN 'Race Cancelled' WHEN contains(d, 'Scratched') THEN 'Scratch' WHEN contains(d, 'Jockey') THEN 'Jockey Change' WHEN contains(d, 'Post Time') THEN 'Post Time Change' WHEN d LIKE '%Wagering Cancelled' THEN 'Wagering' ELSE 'Other' END AS change_type,
    CASE WHEN d LIKE 'Race Cancelled - %' THEN substring(d, 18) ELSE d END AS description FROM c""")
def extract_rss_changes(r):
    horse = r.entries.join(r.horses, "horse_id").select("entry_id", "horse_name")
    c = r.changes.join(r.races.select("race_id", "race_number", "track_code"), "race_id").join(horse, "entry_id", "left")
    d = F.regexp_replace("description", "^Race Cancelled - (.*)$", "<i>Race Cancelled</i> - $1")
    named = F.concat(F.lit("<b># "), F.col("program_number"), F.lit(" "), F.coalesce("horse_name", F.lit("Some Horse")), F.lit("</b> <i>"), d, F.lit("</i>"))
    line = F.concat(F.lit("Race "), F.when(F.col("race_number") < 10, "0").otherwise(""), F.col("race_number").cast("string"), F.lit(": "), F.coalesce(named, d))
    items = c.select("race_id", "track_code", "change_id", line.alias("line")).groupBy(F.col("race_id").alias("doc_id"), "track_code").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("change_id", "line"))), lambda x: x["line"]), "<br/>").alias("description")
    )
    return extract.extract_rss_changes(items).select("doc_id", "line_no", "race_number", "program_number", "horse_name", "change_type", "description")


@query("v_races", "v_entries", "v_horses", sql="""
  SELECT race_id AS doc_id, cast(row_number() OVER (PARTITION BY race_id ORDER BY finish_position) as int) AS k, program_number, CASE finish_position WHEN 1 THEN cast(win_payout as double) END AS win,
         CASE WHEN finish_position <= 2 THEN cast(place_payout as double) END AS place, cast(show_payout as double) AS show FROM v_entries WHERE finish_position <= 3""")
def extract_wps_payouts(r):
    e = r.entries.where("finish_position <= 3")
    prices = F.concat_ws(" ", F.col("win_payout").cast("string"), F.col("place_payout").cast("string"), F.col("show_payout").cast("string"))
    rows = e.withColumn("line", F.concat(F.col("program_number"), F.lit(" Some Horse "), prices, F.lit(" $2 Exacta 99.00")))
    text = rows.groupBy(F.col("race_id").alias("doc_id")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("finish_position", "line"))), lambda x: x["line"]), "\n").alias("t"))
    docs = text.select("doc_id", F.lit(1).alias("segment"), F.concat(F.lit("Total WPS Pool: $1\n"), F.col("t"), F.lit("\nTrainers: none")).alias("text"))
    from pyspark.sql import Window

    out = extract.extract_wps_payouts(docs)
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc_nulls_last("win"), F.desc_nulls_last(F.col("place").isNotNull())))
    return out.select("doc_id", rank.alias("k"), "program_number", _d("win"), _d("place"), _d("show"))


@query("v_entries", "v_jockeys", sql="SELECT race_id AS doc_id, program_number, jockey_name AS trainer_name FROM v_entries JOIN v_jockeys USING (jockey_id)")
def extract_trainers(r):
    e = r.entries.join(r.jockeys, "jockey_id").select("race_id", "entry_id", F.concat_ws(" - ", "program_number", "jockey_name").alias("line"))
    text = e.groupBy(F.col("race_id").alias("doc_id")).agg(F.array_join(F.sort_array(F.collect_list("line")), "; ").alias("t"))
    return extract.extract_trainers(text.select("doc_id", F.lit(1).alias("segment"), F.concat(F.lit("Chart\nTrainers: "), F.col("t"), F.lit("\nOwners: x")).alias("text"))).select("doc_id", "program_number", "trainer_name")
