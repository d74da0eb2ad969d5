"""More queries: shapes, scalar functions, single kinds of bets, and extraction from texts that Spark makes of the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from railbird.functions import changes as ch
from railbird.functions import money, names, racing, times
from railbird.operators import aggregates as agg
from railbird.operators import dedupe, extract, filters, joins, ordering, shapes
from railbird.plans import products
from railbird.plans.catalog import _BET_VIEWS, _FEED_SQL, _FEED_VIEWS, _SETTLE_SQL, _d, query
from railbird.sources import tables
from railbird.sources.views import AS_OF_DATE, AS_OF_TS, EVENTS_AS_OF
from railbird.streaming import changes as late
from railbird.streaming import health, ingest

# --- kinds of bets ---------------------------------------------------------------------------


def _settled(r, *kinds):
    return products.settle_bets(r, AS_OF_DATE).where(F.col("bet_type").isin(*kinds)).select("bet_id", "new_status", _d("payout"))


def _settled_sql(*kinds):
    return _SETTLE_SQL + f"SELECT bet_id, new_status, payout FROM settled WHERE bet_type IN ({', '.join(map(repr, kinds))})"


@query(*_BET_VIEWS, sql=_settled_sql("Win", "Place", "Show"))
def settle_win_place_show(r):
    return _settled(r, "Win", "Place", "Show")


@query(*_BET_VIEWS, sql=_settled_sql("WPS", "Win Place", "Place Show"))
def settle_combo(r):
    return _settled(r, "WPS", "Win Place", "Place Show")


@query(*_BET_VIEWS, sql=_settled_sql("Exacta Box", "Trifecta Box"))
def settle_box(r):
    return _settled(r, "Exacta Box", "Trifecta Box")


@query(*_BET_VIEWS, sql=_settled_sql("Exacta Key", "Trifecta"))
def settle_positional(r):
    return _settled(r, "Exacta Key", "Trifecta")


@query(*_BET_VIEWS, sql=_SETTLE_SQL + "SELECT bet_id, payout FROM settled WHERE new_status = 'Returned'")
def refund_scratched(r):
    return products.settle_bets(r, AS_OF_DATE).where("new_status = 'Returned'").select("bet_id", _d("payout"))


@query(*_BET_VIEWS, sql=_SETTLE_SQL + f"SELECT s.bet_id, new_status FROM settled s JOIN v_bets v ON v.bet_id = s.bet_id JOIN v_races r ON r.race_id = v.race_id WHERE r.race_status <> 'completed' AND race_date <= DATE '{AS_OF_DATE}' - 2")
def settle_stale(r):
    old = r.bets.join(r.races.where(f"race_status <> 'completed' AND race_date <= date_sub(DATE '{AS_OF_DATE}', 2)"), "race_id", "left_semi")
    return products.settle_bets(r, AS_OF_DATE).join(old.select("bet_id"), "bet_id", "left_semi").select("bet_id", "new_status")


@query("v_bets", sql="""SELECT bet_id, CASE WHEN bet_type IN ('Exacta Box', 'Trifecta Box') THEN len(from_json(selection, '["VARCHAR"]')) END AS picks,
  CASE WHEN bet_type IN ('Exacta Key', 'Trifecta') THEN len(from_json(selection, '[["VARCHAR"]]')) END AS positions FROM v_bets""")
def parse_selection_json(r):
    from railbird.operators.betting import parse_selection

    n = lambda c: F.when(F.col(c).isNotNull(), F.size(c)).cast("long").alias(c)
    return parse_selection(r.bets).select("bet_id", n("picks"), n("positions"))


@query(*_BET_VIEWS, sql=_SETTLE_SQL + """
  , ledger AS (SELECT wallet_id, bet_id AS reference_id, 'Bet' AS transaction_type, -bet_cost AS amount, created_at FROM b
    UNION ALL SELECT s.wallet_id, s.bet_id, CASE new_status WHEN 'Win' THEN 'Payout' ELSE 'Refund' END, cast(payout as decimal(12,2)), created_at FROM settled s JOIN v_bets v ON v.bet_id = s.bet_id WHERE new_status IN ('Win', 'Returned') AND payout > 0)
  SELECT wallet_id, reference_id, transaction_type, cast(1000 + sum(amount) OVER (PARTITION BY wallet_id ORDER BY created_at, reference_id, transaction_type ROWS UNBOUNDED PRECEDING) as double) AS balance FROM ledger""")
def running_balance(r):
    from railbird.operators.betting import ledger_entries

    return agg.running_balance(ledger_entries(r.bets, products.settle_bets(r, AS_OF_DATE))).select("wallet_id", "reference_id", "transaction_type", _d("balance"))


# --- feeds and shapes ------------------------------------------------------------------------


@query(*_FEED_VIEWS, sql=_FEED_SQL + "SELECT change_id, source_rank FROM k")
def keep_change(r):
    return filters.kept_changes(products._feed(r, r.races)).select("change_id", "source_rank")


@query(*_FEED_VIEWS, sql=_FEED_SQL + "SELECT change_id, race_id, who, cls FROM k")
def change_identity(r):
    kept = filters.kept_changes(products._feed(r, r.races))
    who = names.change_identity(F.col("program_number"), F.col("horse_name"))
    return kept.select("change_id", "race_id", who.alias("who"), ch.change_type_class(F.col("change_type"), F.col("description")).alias("cls"))


@query(*_FEED_VIEWS, sql=_FEED_SQL + "SELECT change_id, race_key, pgm AS program_number, horse_name, coalesce(description, '') AS description FROM g")
def shape_change(r):
    return products._feed(r, r.races).select("change_id", "race_key", "program_number", "horse_name", "description")


@query(*_FEED_VIEWS, sql=_FEED_SQL + "SELECT change_id, change_type FROM w")
def dedupe_changes(r):
    return dedupe.dedupe_changes(filters.kept_changes(products._feed(r, r.races))).select("change_id", "change_type")


@query(*_FEED_VIEWS, sql=_FEED_SQL + "SELECT change_id, source_rank, who, row_number() OVER (ORDER BY race_date, track_code, race_number, who, change_id, source_rank) AS pos FROM u WHERE n = 1")
def sort_changes(r):
    feed = dedupe.dedupe_changes(filters.kept_changes(products._feed(r, r.races))).select("change_id", "source_rank", "race_date", "track_code", "race_number", "program_number", "horse_name")
    return ordering.numbered(feed, ordering.changes_order()).select("change_id", "source_rank", names.change_identity(F.col("program_number"), F.col("horse_name")).alias("who"), "pos")


@query("v_entries", "v_horses", "v_jockeys", sql="SELECT entry_id, horse_name, cast(foaling_year as varchar) AS foaling_year, jockey_name, scratched FROM v_entries JOIN v_horses USING (horse_id) JOIN v_jockeys USING (jockey_id)")
def shape_entry(r):
    return shapes.shape_entry(joins.join_entry_dims(r.entries, r.horses, r.jockeys)).select("entry_id", "horse_info.horse_name", "horse_info.foaling_year", "jockey_name", "scratched")


@query("v_races", sql="SELECT race_id, CASE WHEN race_status = 'completed' THEN 'chart' ELSE 'static' END AS source FROM v_races")
def annotate_source(r):
    done = F.col("race_status") == "completed"
    return shapes.annotate_source(r.races.where(done).select("race_id"), "chart").union(shapes.annotate_source(r.races.where(~done).select("race_id"), "static"))


@query("v_races", "v_tracks", sql="SELECT race_id, track_code, row_number() OVER (ORDER BY track_code <> 'T07', lower(track_name), race_id) AS pos FROM v_races JOIN v_tracks USING (track_code)")
def sort_pinned_first(r):
    return ordering.numbered(joins.join_track(r.races, r.tracks), ordering.pinned_order("T07", "race_id")).select("race_id", "track_code", "pos")


@query("v_entries", sql="SELECT race_id, entry_id, row_number() OVER (ORDER BY race_id, finish_position NULLS LAST, cast(program_number as int)) AS pos FROM v_entries")
def sort_card_entries(r):
    return ordering.numbered(r.entries, ordering.card_order()).select("race_id", "entry_id", "pos")


@query("v_races", "v_tracks", sql="SELECT track_code, track_code IN ('T01', 'T02') AS is_favourite, race_id FROM v_races")
def split_favourites(r):
    fav = r.tracks.where("track_code IN ('T01', 'T02')")
    return ordering.split_favourites(joins.join_track(r.races, r.tracks), fav, "track_code", "track_name").select("track_code", "is_favourite", "race_id")


# --- scalar functions ------------------------------------------------------------------------


@query("v_changes", sql="""
  SELECT change_id, CASE WHEN change_type <> 'Other' THEN change_type WHEN regexp_matches(lower(description), 'scratch') THEN 'Scratch' WHEN regexp_matches(lower(description), 'wagering|pool') THEN 'Wagering' ELSE 'Other' END AS shown FROM v_changes""")
def display_change_type(r):
    return r.changes.select("change_id", ch.display_change_type(F.col("change_type"), F.col("description")).alias("shown"))


@query("v_changes", sql="""
  SELECT change_id, CASE WHEN contains(lower(description), 'scratched') THEN 'Scratch' WHEN contains(lower(description), 'jockey') THEN 'Jockey Change' WHEN description LIKE 'Race Cancelled%' THEN 'Race Cancelled'
    WHEN contains(lower(description), 'post time') THEN 'Post Time Change' WHEN contains(lower(description), 'wagering') THEN 'Wagering' ELSE 'Other' END AS kind FROM v_changes""")
def change_type_rss(r):
    return r.changes.select("change_id", ch.change_type_rss(F.col("description")).alias("kind"))


@query("v_jockeys", "v_horses", sql="SELECT horse_id, list_aggregate(list_transform(string_split(lower(horse_name), ' '), lambda w: upper(left(w, 1)) || substring(w, 2)), 'string_agg', ' ') || ' O''Neil' AS person FROM v_horses")
def normalize_person_name(r):
    return r.horses.select("horse_id", names.normalize_person_name(F.concat(F.lit(" "), F.upper("horse_name"), F.lit("  O'NEIL"))).alias("person"))


@query("v_races", sql="SELECT race_id, purse, race_id % 2 = 0 AS even, CASE WHEN track_code = 'T05' THEN 'CAN' ELSE 'USA' END AS country FROM v_races")
def clean_purse(r):
    country = racing.country_code(F.when(F.col("track_code") == "T05", "WO").otherwise(F.col("track_code")))
    return r.races.select("race_id", racing.clean_purse(F.concat(F.lit("Purse "), F.col("purse"), F.lit(" added"))).alias("purse"), (F.col("race_id") % 2 == 0).alias("even"), country.alias("country"))


@query("v_races", "v_tracks", sql="""
  SELECT race_id, cast(race_date as timestamp) + cast(post_time as interval) + (CASE timezone WHEN 'America/New_York' THEN INTERVAL 5 HOUR WHEN 'America/Chicago' THEN INTERVAL 6 HOUR WHEN 'America/Los_Angeles' THEN INTERVAL 8 HOUR ELSE INTERVAL 7 HOUR END)
    - (CASE WHEN timezone <> 'America/Phoenix' AND (month(race_date) BETWEEN 5 AND 10 OR month(race_date) = 4 AND dayofweek(race_date) = 0) THEN INTERVAL 1 HOUR ELSE INTERVAL 0 HOUR END) AS at
  FROM v_races JOIN v_tracks USING (track_code)""")
def post_ts(r):
    return joins.join_track(r.races, r.tracks).select("race_id", times.post_ts(F.col("race_date"), F.col("post_time"), F.col("timezone")).cast("timestamp_ntz").alias("at"))


@query("v_races", sql=f"SELECT race_id, CASE WHEN race_date < DATE '{AS_OF_DATE}' THEN 'past_drf_only' ELSE 'upcoming' END AS first_status, coalesce(CASE WHEN race_id % 2 = 0 THEN race_status END, 'upcoming') AS kept_status FROM v_races")
def initial_and_preserved_status(r):
    old = F.when(F.col("race_id") % 2 == 0, F.col("race_status"))
    return r.races.select("race_id", times.initial_status(F.col("race_date"), F.lit(AS_OF_DATE).cast("date")).alias("first_status"), times.preserve_status(old).alias("kept_status"))


@query("v_crawl_events", sql=f"""
  SELECT event_id, cast(floor((epoch(TIMESTAMP '{EVENTS_AS_OF}') - floor(epoch(seen_at))) / 60) as bigint) AS age, floor((epoch(TIMESTAMP '{EVENTS_AS_OF}') - floor(epoch(seen_at))) / 60) > 300 AS stale, (hour(seen_at) + 19) % 24 BETWEEN 8 AND 23 AS racing FROM v_crawl_events""")
def age_and_hours(r):
    now = F.lit(EVENTS_AS_OF).cast("timestamp")
    return r.crawl_events.select("event_id", times.age_minutes(F.col("seen_at"), now).alias("age"), times.is_stale(F.col("seen_at"), now, F.lit(300)).alias("stale"), times.racing_hours(F.col("seen_at").cast("timestamp")).alias("racing"))


@query("v_races", sql="SELECT race_id, race_date AS d1, race_date AS d2, race_date AS d3 FROM v_races")
def parse_dates(r):
    d = F.col("race_date")
    rss = F.concat(F.date_format(d, "E, dd MMM yyyy"), F.lit(" 23:59:00 EST"))
    return r.races.select("race_id", times.parse_rfc822_date(rss).alias("d1"), times.parse_text_date(F.concat(F.lit("Chart ("), F.date_format(d, "M/d/yyyy"), F.lit(")"))).alias("d2"), times.parse_text_date(F.upper(F.date_format(d, "EEEE, MMMM d, yyyy"))).alias("d3"))


@query("v_races", sql="SELECT race_id, track_code AS code, race_date, race_number FROM v_races")
def parse_chart_url(r):
    letters = F.translate("track_code", "T0123456789", "TABCDEFGHIJ")
    url = racing.chart_url("http://charts/", letters, F.col("race_date"), F.col("race_number"))
    c = racing.parse_chart_url(url)
    return r.races.select("race_id", F.translate(c["track_code"], "TABCDEFGHIJ", "T0123456789").alias("code"), c["race_date"].alias("race_date"), c["race_number"].alias("race_number"))


@query("v_entries", "v_races", sql="""
  , f AS (SELECT race_id, entry_id, 20 + entry_id % 55 AS t, row_number() OVER (PARTITION BY race_id, entry_id % 55 < 50 ORDER BY entry_id) AS n FROM v_entries)
  SELECT race_id, coalesce(string_agg(cast(t as varchar) || '.25', ', ' ORDER BY entry_id) FILTER (WHERE n <= 4 AND t < 70), '') AS fractions FROM f GROUP BY 1""")
def fractional_times(r):
    said = r.entries.groupBy("race_id").agg(F.sort_array(F.collect_list(F.struct("entry_id"))).alias("e"))
    text = F.array_join(F.transform("e", lambda x: F.concat((F.lit(20) + x["entry_id"] % 55).cast("string"), F.lit(".25"))), " then ")
    return said.select("race_id", racing.fractional_times(text).alias("fractions"))


@query("v_bets", sql="""
  , p AS (SELECT bet_id, bet_type, from_json(selection, '[["VARCHAR"]]') AS x FROM v_bets WHERE bet_type IN ('Trifecta', 'Exacta Key'))
  SELECT bet_id, CASE bet_type WHEN 'Trifecta' THEN (SELECT count(*) FROM (SELECT unnest(x[1]) AS a) , (SELECT unnest(x[2]) AS b), (SELECT unnest(x[3]) AS c) WHERE a <> b AND b <> c AND a <> c)
    ELSE (SELECT count(*) FROM (SELECT unnest(x[1]) AS a) , (SELECT unnest(x[2]) AS b) WHERE a <> b) END AS combos FROM p""")
def key_combos(r):
    keyed = r.bets.where("bet_type IN ('Trifecta', 'Exacta Key')")  # the kinds that have positions
    return keyed.select("bet_id", money.key_combos(F.from_json("selection", "array<array<string>>")).alias("combos"))


@query("v_races", "v_entries", "v_horses", sql="""
  SELECT race_id, lower(regexp_replace(horse_name, '[^A-Za-z0-9]', '', 'g')) AS norm_name, max(horse_name) AS display_name FROM v_entries JOIN v_horses USING (horse_id) GROUP BY 1, 2""")
def best_display_name(r):
    named = r.entries.join(r.horses, "horse_id").select("race_id", "horse_name")
    squeezed = named.withColumn("horse_name", F.replace("horse_name", F.lit(" ")))
    return dedupe.best_display_name(named.union(squeezed))


@query("v_races", sql="""
  , m AS (SELECT track_code, race_date, race_number, race_id, CASE WHEN race_id % 3 = 0 THEN surface END AS s FROM v_races)
  SELECT race_id, last_value(s IGNORE NULLS) OVER (PARTITION BY track_code, race_date ORDER BY race_number ROWS UNBOUNDED PRECEDING) AS s FROM m""")
def carry_forward_header(r):
    marked = r.races.select("track_code", "race_date", "race_number", "race_id", F.when(F.col("race_id") % 3 == 0, F.col("surface")).alias("s"))
    return dedupe.carry_forward(marked, "s", order="race_number", keys=("track_code", "race_date")).select("race_id", "s")


@query("v_races", sql="SELECT race_id, cast(sum(CASE WHEN race_id % 4 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY track_code, race_date ORDER BY race_number) as bigint) AS segment FROM v_races")
def page_segments(r):
    pages = r.races.select(F.concat_ws("-", "track_code", "race_date").alias("doc_id"), F.col("race_number").alias("page_no"), "race_id")
    return dedupe.page_segments(pages, F.col("race_id") % 4 == 0).select("race_id", F.col("segment").cast("long").alias("segment"))


@query("v_entries", sql="SELECT entry_id, row_number() OVER (PARTITION BY race_id ORDER BY price DESC, entry_id) AS finish_position FROM v_entries")
def finish_by_order(r):
    w = Window.partitionBy("race_id").orderBy(F.desc("price"), "entry_id")
    rows = r.entries.drop("finish_position").withColumn("line_no", F.row_number().over(w))
    return dedupe.finish_by_order(rows, ("race_id",)).select("entry_id", F.col("finish_position").cast("long").alias("finish_position"))


@query("v_crawl_events", sql="SELECT feed AS snapshot_key, arg_max(event_id, struct_pack(a := seen_at, b := event_id)) AS payload, max(seen_at) AS captured_at FROM v_crawl_events GROUP BY 1")
def latest_snapshot(r):
    return dedupe.latest_snapshot(r.crawl_events.select(F.col("feed").alias("snapshot_key"), F.col("event_id").alias("payload"), F.col("seen_at").alias("captured_at")))


@query("v_crawl_events", sql=f"""
  SELECT feed, event_id FROM v_crawl_events WHERE CASE event_id % 3 WHEN 0 THEN true WHEN 1 THEN cast(seen_at as date) = DATE '2024-01-20' ELSE false END""")
def fresh_document(r):
    said = F.when(F.col("event_id") % 3 == 0, "").when(F.col("event_id") % 3 == 1, F.concat(F.date_format("seen_at", "E, dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))).otherwise("yesterday")
    return filters.fresh(r.crawl_events.withColumn("published", said), "published", "2024-01-20").select("feed", "event_id")


@query("v_tracks", sql="SELECT track_code FROM v_tracks WHERE track_code <> 'T03'")
def schedule_skip(r):
    known = r.tracks.withColumn("has_card", F.when(F.col("track_code") == "T03", False).when(F.col("track_code") > "T10", True))
    return filters.schedule_skip(known).select("track_code")


@query("v_entries", sql="SELECT entry_id, cast(win_payout as double) AS win, CASE WHEN entry_id % 2 = 0 THEN 'T' || trainer_id ELSE 'kept' END AS trainer_name FROM v_entries")
def match_payouts_by_pgm(r):
    h = r.entries.select("race_id", "program_number", "entry_id", F.when(F.col("entry_id") % 2 == 1, "kept").otherwise("").alias("trainer_name"))
    p = r.entries.where("win_payout IS NOT NULL").select("race_id", "program_number", F.col("win_payout").alias("win"))
    t = r.entries.select("race_id", "program_number", F.concat(F.lit("T"), F.col("trainer_id").cast("string")).alias("trainer_name"))
    return joins.match_payouts(h, p, t).select("entry_id", _d("win"), "trainer_name")


@query("v_races", "v_entries", sql="SELECT race_id, program_number FROM v_entries WHERE race_id % 2 = 0")
def race_map(r):
    parsed = r.entries.groupBy(F.col("race_id").alias("doc_id")).agg(F.collect_list("program_number").alias("horses"))
    every = parsed.select("doc_id", F.lit(1).alias("seq"), F.when(F.col("doc_id") % 2 == 0, "1").otherwise("x").alias("race_number"), "horses")
    return agg.race_map(every.union(every.select("doc_id", F.lit(0), "race_number", F.array().cast("array<string>")))).select(F.col("doc_id").alias("race_id"), F.explode("horses").alias("program_number"))


# --- extraction ------------------------------------------------------------------------------


def _joined(df, key, order, line, by="\n"):
    rows = F.sort_array(F.collect_list(F.struct(*order, line.alias("_line"))))
    return df.groupBy(*([key] if isinstance(key, str) else key)).agg(F.array_join(F.transform(rows, lambda x: x["_line"]), by).alias("text"))


@query("v_entries", "v_horses", "v_jockeys", sql="SELECT race_id AS doc_id, program_number, regexp_replace(horse_name, '[^A-Za-z0-9 ''-]', '', 'g') AS horse_name, jockey_name AS jockey, finish_position FROM v_entries JOIN v_horses USING (horse_id) JOIN v_jockeys USING (jockey_id) WHERE finish_position IS NOT NULL")
def extract_table_horses(r):
    e = r.entries.where("finish_position IS NOT NULL").join(r.horses, "horse_id").join(r.jockeys, "jockey_id")
    doc, place = F.col("race_id").alias("doc_id"), F.col("finish_position")
    # The first two places and three rows that are no runners in one table, the rest on the next page, below its header.
    late = place > 2
    own = e.select(doc, F.when(late, 2).otherwise(1).alias("table_no"), (place * 2).alias("row_no"), F.array("program_number", "horse_name", "jockey_name", F.lit("Trainer"), F.lit("5/2")).alias("cells"))
    races = e.select("race_id").distinct()
    made = [(1, 0, ["Pgm", "Horse", "Jockey", "Trainer", "Odds"]), (1, 3, ["9", "Gone", "X", "Scratched", ""]), (1, 98, ["", "Total WPS Pool", "", "", ""]), (1, 99, ["x", "Winner: y", "", "", ""]), (1, 101, ["a", "b"]), (1, 102, ["a", "b"]), (1, 103, ["a", "b"]), (1, 104, ["a", "b"]), (1, 105, ["a", "b"]), (2, 0, ["Pgm", "Horse", "Jockey", "Trainer"]), (3, 0, ["z", "No Runner", "of another table"])]
    each = races.select(doc, F.explode(F.array(*(F.struct(F.lit(t).alias("table_no"), F.lit(n).alias("row_no"), F.array(*map(F.lit, c)).alias("cells")) for t, n, c in made))).alias("x")).select("doc_id", "x.*")
    return extract.extract_table_horses(own.unionByName(each)).select("doc_id", "program_number", "horse_name", "jockey", "finish_position")


@query("v_claims", "v_horses", sql="""
  SELECT race_id AS doc_id, cast(row_number() OVER (PARTITION BY race_id ORDER BY claim_id) as int) AS row, horse_name, coalesce(new_trainer_name, 'Nobody') AS new_trainer_name, 'Big Stable ' || claim_id % 9 AS new_owner_name,
         cast(max(cast(floor(claim_price) as bigint)) OVER (PARTITION BY race_id) as double) AS claim_price FROM v_claims JOIN v_horses USING (horse_id)""")
def extract_claims(r):
    c = r.claims.join(r.horses, "horse_id")
    owner = F.when(F.col("claim_id") % 2 == 0, " New Owner: Big\nStable ").otherwise(" New Ow|ner: Big Stable ")  # a broken line, a broken label
    line = F.concat("horse_name", F.lit(" New Trainer: "), F.coalesce("new_trainer_name", F.lit("Nobody")), owner, (F.col("claim_id") % 9).cast("string"))
    dear = F.max(F.floor("claim_price").cast("long")).cast("string").alias("dear")
    text = _joined(c, "race_id", ["claim_id"], line).join(c.groupBy("race_id").agg(dear), "race_id")
    docs = text.select(F.col("race_id").alias("doc_id"), F.lit(1).alias("segment"), F.concat(F.lit("Claiming Price: $"), "dear", F.lit("\nClaimed Horse(s): "), "text", F.lit("\nFootnotes")).alias("text"))
    return extract.extract_claims(docs).select("doc_id", F.col("row").cast("int").alias("row"), "horse_name", "new_trainer_name", "new_owner_name", _d("claim_price"))


# --- streams' batch twins --------------------------------------------------------------------


@query("v_entries", "v_races", sql="""
  , res AS (SELECT race_id, program_number, finish_position FROM v_entries WHERE finish_position IS NOT NULL AND program_number <> '2'), n AS (SELECT race_id, count(*) AS k FROM res GROUP BY 1)
  SELECT e.entry_id, CASE WHEN res.race_id IS NOT NULL THEN false WHEN k >= 3 THEN true ELSE e.scratched END AS scratched,
         CASE WHEN res.race_id IS NOT NULL THEN res.finish_position WHEN k >= 3 AND NOT e.scratched THEN NULL ELSE e.finish_position END AS finish_position
  FROM v_entries e LEFT JOIN res ON res.race_id = e.race_id AND res.program_number = e.program_number LEFT JOIN n ON n.race_id = e.race_id""")
def apply_results(r):
    results = r.entries.where("finish_position IS NOT NULL AND program_number <> '2'").select("race_id", "program_number", "finish_position")
    return late.apply_results(r.races, r.entries, results)[1].select("entry_id", "scratched", "finish_position")


@query("v_races", "v_entries", "v_changes", sql="SELECT entry_id, CASE WHEN race_id % 5 = 0 THEN false ELSE scratched END AS scratched, CASE WHEN race_id % 5 = 0 THEN NULL ELSE finish_position END AS finish_position FROM v_entries")
def reset_card(r):
    return late.reset_races(r.races, r.entries, r.changes, r.races.where("race_id % 5 = 0"))[1].select("entry_id", "scratched", "finish_position")


@query("v_changes", sql="SELECT race_id, change_type, description, arg_min(change_id, struct_pack(a := created_at, b := change_id)) AS change_id FROM v_changes GROUP BY 1, 2, 3")
def stream_dedupe(r):
    return late.stream_dedupe(r.changes, ["race_id", "change_type", "description"], "created_at").select("race_id", "change_type", "description", "change_id")


@query("v_crawl_events", sql="SELECT event_id FROM v_crawl_events WHERE cast(seen_at as date) = DATE '2024-01-20'")
def late_change_filter(r):
    return late.late_change_filter(r.crawl_events.withColumn("published_ts", F.col("seen_at").cast("timestamp")), "2024-01-20").select("event_id")


@query("v_crawl_events", sql="""
  , s AS (SELECT feed || source AS key, seen_at AS tm, kind = 'failure' AS o FROM v_crawl_events), told AS (SELECT feed || source AS key, seen_at AS tm, CASE WHEN kind = 'failure' THEN 'opened' ELSE 'resolved' END AS event FROM v_crawl_events WHERE event_id % 2 = 0),
  l AS (SELECT *, lag(o) OVER (PARTITION BY key ORDER BY tm) AS p FROM s),
  a AS (SELECT key, count(*) FILTER (WHERE o) AS count, min(tm) AS first_seen, max(tm) AS last_seen, arg_max(o, tm) AS open, max(tm) FILTER (WHERE o AND p IS DISTINCT FROM true) AS opened_at, max(tm) FILTER (WHERE NOT o AND p) AS ended FROM l GROUP BY 1)
  SELECT key, count, first_seen, last_seen, open, opened_at, CASE WHEN NOT open THEN ended END AS resolved_at, EXISTS (SELECT 1 FROM told WHERE told.key = a.key AND event = 'opened' AND told.tm >= opened_at) AS notified_open,
         NOT open AND EXISTS (SELECT 1 FROM told WHERE told.key = a.key AND event = 'resolved' AND told.tm >= ended) AS notified_resolved FROM a""")
def alert_lifecycle(r):
    opens = F.col("kind") == "failure"
    s = r.crawl_events.select(F.concat("feed", "source").alias("key"), F.col("seen_at").alias("at"), opens.alias("is_open"))
    told = r.crawl_events.where("event_id % 2 = 0").select(F.concat("feed", "source").alias("key"), F.col("seen_at").alias("at"), F.when(opens, "opened").otherwise("resolved").alias("event"))
    return health.alert_lifecycle(s, told)


@query("v_crawl_events", sql="""
  , s AS (SELECT feed || source AS key, seen_at AS tm, kind = 'failure' AS o FROM v_crawl_events), a AS (SELECT key, arg_max(o, tm) AS open, max(tm) FILTER (WHERE o) AS last_open FROM s GROUP BY 1)
  SELECT key, CASE WHEN open THEN 'opened' ELSE 'resolved' END AS event FROM a WHERE open AND NOT key LIKE 'r%' OR NOT open AND key LIKE 'r%' AND last_open IS NOT NULL""")
def pending_notifications(r):
    s = r.crawl_events.select(F.concat("feed", "source").alias("key"), F.col("seen_at").alias("at"), (F.col("kind") == "failure").alias("is_open"))
    told = s.where("is_open AND key LIKE 'r%'").select("key", "at", F.lit("opened").alias("event"))  # of alerts of one feed the opening was told
    return health.pending_notifications(health.alert_lifecycle(s, told)).select("key", "event")


@query("v_races", sql=f"SELECT 'zero_races' AS key, 'critical' AS severity FROM v_races WHERE race_date = DATE '2030-01-01' HAVING count(*) = 0")
def zero_activity_alert(r):
    total = r.races.where(F.col("race_date") == F.lit("2030-01-01").cast("date")).agg(F.count("*").alias("total"))
    return health.zero_activity(total, AS_OF_TS)


# --- further joins, orders and texts ---------------------------------------------------------


@query("v_claims", "v_entries", "v_horses", sql="""
  , e AS (SELECT race_id, entry_id AS seq, lower(regexp_replace(horse_name, '[^A-Za-z0-9]', '', 'g')) AS p, cast(floor(price) as bigint) AS price FROM v_entries JOIN v_horses USING (horse_id)),
  c AS (SELECT race_id, claim_id, lower(regexp_replace(split_part(horse_name, ' ', 1), '[^A-Za-z0-9]', '', 'g')) AS c FROM v_claims JOIN v_horses USING (horse_id)),
  m AS (SELECT claim_id, e.price, row_number() OVER (PARTITION BY claim_id ORDER BY c <> p, seq) AS n FROM c JOIN e ON e.race_id = c.race_id AND (c = p OR contains(c, p) OR contains(p, c)))
  SELECT claim_id, price AS claim_price FROM v_claims LEFT JOIN (SELECT * FROM m WHERE n = 1) USING (claim_id)""")
def match_claim_price(r):
    said = r.claims.join(r.horses, "horse_id").select("race_id", "claim_id", F.split_part("horse_name", F.lit(" "), F.lit(1)).alias("horse_name"))
    prices = r.entries.join(r.horses, "horse_id").select("race_id", F.col("entry_id").alias("seq"), F.col("horse_name").alias("priced_name"), F.floor("price").cast("long").alias("price"))
    return joins.match_claim_price(said, prices).select("claim_id", "claim_price")


@query("v_entries", "v_entries_raw", sql="""
  SELECT race_id, program_number, horse_id FROM (SELECT race_id, cast(line as varchar) AS program_number, horse_id, row_number() OVER (PARTITION BY race_id, line ORDER BY horse_id % 2 DESC, horse_id DESC, jockey_id DESC) AS n FROM v_entries_raw) WHERE n = 1""")
def prefer_detail_entries(r):
    rows = r.entries_raw.select("race_id", F.col("line").cast("string").alias("program_number"), "horse_id", (F.col("horse_id") % 2 == 1).alias("is_detail"), F.col("horse_id").alias("page_no"), F.col("jockey_id").alias("line_no"))
    return dedupe.prefer_detail_entries(rows).select("race_id", "program_number", "horse_id")


@query("v_races", "v_tracks", sql="SELECT race_id, row_number() OVER (ORDER BY lower(purse) DESC, race_id) AS pos FROM v_races")
def sort_table_ui(r):
    return ordering.numbered(r.races, ordering.table_order(r.races, "purse", True)).select("race_id", "pos")


@query("v_entries", "v_races", sql="SELECT entry_id, race_key, row_number() OVER (ORDER BY race_date DESC, race_number DESC, entry_id) AS pos FROM v_entries e JOIN v_races r ON r.race_id = e.race_id")
def sort_history(r):
    return ordering.numbered(products._starts(r), ordering.history_order()).select("entry_id", "race_key", "pos")


@query("v_horses", "v_entries", "v_races", sql="""
  , q AS (SELECT horse_name AS request, count(*) AS n, min(horse_id) AS h FROM v_horses GROUP BY 1), s AS (SELECT horse_id, count(*) AS starts FROM v_entries e JOIN v_races r ON r.race_id = e.race_id WHERE race_status = 'completed' AND NOT scratched GROUP BY 1)
  SELECT request, CASE WHEN n = 1 THEN 'matched' ELSE 'ambiguous' END AS outcome, CASE WHEN n = 1 THEN starts END AS starts FROM q LEFT JOIN s ON s.horse_id = q.h""")
def horse_profile(r):
    asked = r.horses.select(F.col("horse_name").alias("request")).distinct()
    return products.horse_profiles(r, asked).select("request", "outcome", "starts")


@query("v_races", sql="SELECT track_code || cast(race_date as varchar) AS doc_id, cast(race_number as int) AS segment, 'Race ' || race_number || ' 1998' || chr(10) || 'more of ' || race_id AS text FROM v_races")
def extract_chart_races(r):
    doc = F.concat("track_code", F.col("race_date").cast("string")).alias("doc_id")
    n = F.col("race_number")
    head = r.races.select(doc, (n * 2).alias("page_no"), F.concat(F.lit("Race "), n.cast("string"), F.lit(" 1998")).alias("text"))
    rest = r.races.select(doc, (n * 2 + 1).alias("page_no"), F.concat(F.lit("more of "), F.col("race_id").cast("string")).alias("text"))
    return extract.extract_chart_races(head.union(rest)).select("doc_id", F.col("segment").cast("int").alias("segment"), "text")


@query("v_tracks", sql="SELECT DISTINCT 'T' || chr(65 + cast(substring(track_code, 2, 2) as int)) AS track_code, 'latechangesT' || chr(65 + cast(substring(track_code, 2, 2) as int)) || '-USA.html' AS url FROM v_tracks")
def extract_change_links(r):
    code = F.concat(F.lit("T"), F.chr(F.substring("track_code", 2, 2).cast("int") + 65))
    pages = r.tracks.select(F.col("track_code").alias("page_id"), F.concat(F.lit('<a href="other.html">x</a> <a HREF="latechanges'), code, F.lit('-USA.html">y</a>')).alias("html"))
    return extract.extract_change_links(pages)


@query("v_races", sql="SELECT race_id, CASE race_id % 3 WHEN 0 THEN 'Gulfstream Park' WHEN 1 THEN 'Woodbine' ELSE 'Some Course' END AS name, CASE race_id % 3 WHEN 0 THEN 'GP' WHEN 1 THEN 'WO' END AS code, CASE race_id % 3 WHEN 1 THEN 'America/Toronto' ELSE 'America/New_York' END AS zone FROM v_races")
def track_functions(r):
    said = F.when(F.col("race_id") % 3 == 0, "GULFSTREAM PARK").when(F.col("race_id") % 3 == 1, "woodbine").otherwise("Some Course")
    code = racing.track_code_from_text(said, F.lit(""))
    return r.races.select("race_id", racing.canonical_track_name(said).alias("name"), code.alias("code"), racing.track_timezone(code).alias("zone"))


@query("v_crawl_events", sql=f"""
  , a AS (SELECT feed, max(seen_at) AS l, max(CASE WHEN kind = 'success' OR (kind = 'signal' AND feed = 'scratches') THEN seen_at END) AS s, max(CASE WHEN kind = 'failure' THEN seen_at END) AS f FROM v_crawl_events WHERE seen_at <= TIMESTAMP '{EVENTS_AS_OF}' GROUP BY 1),
  b AS (SELECT *, coalesce(floor((epoch(TIMESTAMP '{EVENTS_AS_OF}') - floor(epoch(s))) / 60) > CASE feed WHEN 'entries' THEN 300 WHEN 'results' THEN 30 ELSE 20 END, true) AS late, floor((epoch(TIMESTAMP '{EVENTS_AS_OF}') - floor(epoch(l))) / 60) < 20 AND coalesce(f < l, true) AS busy FROM a)
  SELECT feed, CASE WHEN late AND NOT busy AND NOT coalesce(f = l, false) THEN 'recovering' WHEN late AND NOT busy THEN 'attention_needed' WHEN late THEN 'running' ELSE 'ok' END AS public_status FROM b""")
def feed_public_status(r):
    return health.feed_public_status(health.feed_freshness(r.crawl_events, EVENTS_AS_OF)).select("feed", "public_status")


@query("v_crawl_events", sql="SELECT feed, floor(epoch(seen_at) / 60) * 60 AS minute, count(*) AS failures FROM v_crawl_events WHERE kind = 'failure' GROUP BY 1, 2")
def failures_by_minute(r):
    minute = (F.floor(F.unix_timestamp("seen_at") / 60) * 60).cast("double")
    return r.crawl_events.where("kind = 'failure'").groupBy("feed", minute.alias("minute")).agg(F.count("*").alias("failures"))


@query("v_races", "v_tracks", sql=f"SELECT (SELECT count(*) FROM v_races) AS races, (SELECT count(DISTINCT race_date) FROM v_races WHERE race_date <= DATE '{AS_OF_DATE}') AS dates, (SELECT count(*) FROM v_tracks) AS tracks")
def filter_options(r):
    dates, tracks = products.filter_options(r, AS_OF_DATE)
    kinds = {"races": r.races, "dates": dates, "tracks": tracks}
    rows = [df.select(F.lit(n).alias("kind")) for n, df in kinds.items()]
    return rows[0].union(rows[1]).union(rows[2]).agg(*(F.count_if(F.col("kind") == n).alias(n) for n in kinds))


# --- readers, snapshots, labels, forms -------------------------------------------------------


@query("v_races", sql="SELECT race_id, cast(race_number as int) AS race_number, 'Post Time Change' AS change_type FROM v_races")
def read_rss_items(r):
    """Written as feed files and read back."""
    path = tables.scratch_dir(r.spark)
    item = r.races.select(F.concat(F.lit("Race "), F.col("race_number").cast("string"), F.lit(": <i>Post Time</i> changed to 1:30 PM; "), F.col("race_id").cast("string")).alias("description"), F.lit("Mon, 01 Jun 1998 10:00:00 EST").alias("pubDate"))
    item.write.format("xml").option("rootTag", "rss").option("rowTag", "item").save(path)
    changes = extract.extract_rss_changes(tables.read_rss_items(r.spark, path).select("doc_id", "track_code", "description"))
    return changes.select(F.regexp_extract("description", r"(\d+)$", 1).cast("long").alias("race_id"), "race_number", "change_type")


@query("v_races", sql="SELECT race_id, track_code FROM v_races")
def read_html_pages(r):
    """Pages of several lines, written as files and read back whole."""
    path = tables.scratch_dir(r.spark)
    r.races.select(F.concat(F.lit("<a id='"), F.col("race_id").cast("string"), F.lit("'>\n"), "track_code", F.lit("</a>")).alias("value")).write.text(path)
    found = tables.read_html_pages(r.spark, path).select(F.explode(F.regexp_extract_all("html", F.lit(r"(?s)<a id='(\d+'>\n\w+)</a>"), F.lit(1))).alias("x"))
    return found.select(F.split_part("x", F.lit("'>\n"), F.lit(1)).cast("long").alias("race_id"), F.split_part("x", F.lit("'>\n"), F.lit(2)).alias("track_code"))


@query("v_races", sql="SELECT track_code AS doc_id, cast(race_id % 1000000 as int) AS page_no, race_key AS text FROM v_races")
def read_text_pages(r):
    path = tables.scratch_dir(r.spark)
    r.races.select(F.col("track_code").alias("doc_id"), (F.col("race_id") % 1_000_000).cast("int").alias("page_no"), F.col("race_key").alias("text")).write.parquet(path)
    return tables.read_text_pages(r.spark, path)


@query("v_races", sql="SELECT track_code, count(*) AS total FROM v_races GROUP BY 1")
def write_and_read_snapshot(r):
    path = tables.scratch_dir(r.spark)
    total = r.races.groupBy("track_code").agg(F.count("*").alias("total"))
    tables.write_snapshot(total.withColumn("total", F.lit(0).cast("long")), path, "summary", "1998-06-01 10:00:00")
    tables.write_snapshot(total.withColumn("total", F.lit(1).cast("long")), path, "other", "1998-06-01 12:00:00")
    tables.write_snapshot(total, path, "summary", "1998-06-01 11:00:00")
    return tables.read_snapshot(r.spark, path, "summary").select("track_code", "total")


@query("v_races", "v_entries", sql="""
  SELECT race_id, '$' || (race_id % 900 + 100) || '000 and $' || (race_id % 90 + 10) || '500000' AS purse, CASE race_id % 3 WHEN 0 THEN 'Colt' WHEN 1 THEN 'Mare' ELSE 'x' END AS sex,
         CASE race_status WHEN 'past_drf_only' THEN 'Past Drf Only' ELSE upper(left(race_status, 1)) || substring(race_status, 2) END AS status, CASE race_id % 3 WHEN 0 THEN track_code WHEN 1 THEN 'Woodbine' ELSE 'Some Park' END AS shown FROM v_races""")
def labels_and_currency(r):
    k = F.col("race_id") % 3
    said = F.concat(F.lit("$"), (F.col("race_id") % 900 + 100).cast("string"), F.lit(", 000 and $"), (F.col("race_id") % 90 + 10).cast("string"), F.lit(",500,000"))
    shown = racing.track_display_name(F.when(k == 2, "Some Park").when(k == 1, ""), F.when(k == 1, "WO").otherwise(F.col("track_code")))
    sex = names.sex_label(F.when(k == 0, "c").when(k == 1, "M").otherwise("x"))
    return r.races.select("race_id", racing.merge_split_currency(said).alias("purse"), sex.alias("sex"), names.status_label(F.col("race_status")).alias("status"), shown.alias("shown"))


@query("v_crawl_events", sql=f"""
  , a AS (SELECT feed, max(CASE WHEN kind = 'success' OR (kind = 'signal' AND feed = 'scratches') THEN seen_at END) AS s FROM v_crawl_events WHERE seen_at <= TIMESTAMP '{EVENTS_AS_OF}' GROUP BY 1)
  SELECT feed, true AS within_startup_grace, false AS stale FROM a""")
def within_grace(r):
    return health.feed_freshness(r.crawl_events, EVENTS_AS_OF, "2024-01-20 11:50:00").select("feed", "within_startup_grace", "stale")


@query("v_crawl_events", sql="SELECT event_id AS upload_id, seen_at AS uploaded_at FROM v_crawl_events ORDER BY seen_at DESC, event_id DESC LIMIT 10")
def recent_uploads(r):
    return products.recent_uploads(r.crawl_events.select(F.col("event_id").alias("upload_id"), F.col("seen_at").alias("uploaded_at")))


@query("v_tracks", sql="SELECT track_code, track_name, timezone FROM v_tracks")
def tracks(r):
    return products.tracks(r)


@query("v_changes", "v_races", sql="SELECT track_code, c.race_id AS doc_id, change_id AS line_no, change_type, description, row_number() OVER (PARTITION BY track_code ORDER BY c.race_id, change_id) AS place FROM v_changes c JOIN v_races r ON r.race_id = c.race_id")
def group_changes_by_track(r):
    rows = r.changes.join(r.races.select("race_id", "track_code"), "race_id").select("track_code", F.col("race_id").alias("doc_id"), F.col("change_id").alias("line_no"), "change_type", "description")
    return late.group_changes_by_track(rows)


@query("v_changes", "v_races", "v_entries", sql=r"""
  , c AS (SELECT c.*, r.race_date, coalesce(c.program_number, '') AS pgm, regexp_extract(c.description, 'changed to\s+(\d{1,2}:\d{2}\s*(?:AM|PM)?)', 1) AS t FROM v_changes c JOIN v_races r ON r.race_id = c.race_id WHERE c.description <> ''),
  m AS (SELECT *, CASE WHEN lower(description) LIKE '%scratched%' THEN 'Scratch' WHEN lower(description) LIKE '%jockey%' THEN 'Jockey Change'
      WHEN lower(description) LIKE '%cancel%' AND NOT regexp_matches(lower(description), 'wagering|simulcast|pool|turf racing|superfecta|trifecta|exacta|daily double|pick|quinella|win|place|show|omnibus') THEN 'Race Cancelled'
      WHEN lower(description) LIKE '%post time%' THEN 'Post Time Change' WHEN lower(description) LIKE '%cancel%' AND lower(description) LIKE '%wagering%' THEN 'Wagering' ELSE 'Other' END AS kind FROM c),
  k AS (SELECT *, CASE WHEN kind IN ('Scratch', 'Jockey Change') THEN entry_id END AS entry FROM m WHERE kind NOT IN ('Scratch', 'Jockey Change') OR entry_id IS NOT NULL),
  w AS (SELECT race_id, max(change_id) FILTER (WHERE kind = 'Post Time Change') AS late, max(change_id) FILTER (WHERE kind = 'Race Cancelled') AS off, min(change_id) FILTER (WHERE kind = 'Post Time Change') AS first_late,
      max_by(upper(t), change_id) FILTER (WHERE kind = 'Post Time Change' AND t <> '') AS new_time, max_by('Weather', change_id) FILTER (WHERE kind = 'Race Cancelled') AS why FROM k GROUP BY 1),
  ran AS (SELECT DISTINCT race_id FROM v_entries WHERE finish_position IN (1, 2, 3))
  SELECT 'change' AS what, race_id AS id, entry AS entry_id, kind AS state, CAST(NULL AS VARCHAR) AS post_time, CAST(NULL AS VARCHAR) AS reason FROM k GROUP BY race_id, entry, kind
  UNION ALL SELECT 'scratched', e.entry_id, NULL, NULL, NULL, NULL FROM v_entries e WHERE scratched OR entry_id IN (SELECT entry FROM k WHERE kind = 'Scratch')
  UNION ALL SELECT 'race', r.race_id, NULL, CASE WHEN off IS NOT NULL AND ran.race_id IS NULL AND (race_status <> 'completed' OR off > first_late) AND (late IS NULL OR off > late) THEN 'cancelled' WHEN late IS NOT NULL THEN 'delayed' ELSE race_status END,
      coalesce(new_time, post_time), coalesce(why, cancellation_reason)
  FROM v_races r LEFT JOIN w ON w.race_id = r.race_id LEFT JOIN ran ON ran.race_id = r.race_id""")
def stream_ingest(r):
    """Feed items of all days, as a stream of two batches into a store: its changes, races and scratched entries afterwards."""
    spark, root = r.spark, tables.scratch_dir(r.spark)
    days = r.races.select("race_id", "race_date")
    entries = r.entries.join(days, "race_id").join(r.horses, "horse_id").select("entry_id", "race_id", "race_date", "program_number", "horse_name", "scratched", "finish_position")
    races = r.races.select("race_id", "race_date", "track_code", "race_number", "race_status", "post_time", "is_cancelled", "cancellation_reason")
    ingest.create_store(f"{root}/store", races, entries)
    # Changes are of the races and entries as stored: worked out again, these would be shuffled whole.
    r = r.over(**{t: ingest.read_store(spark, f"{root}/store", t) for t in ("races", "entries")})
    c = r.changes.join(r.races.select("race_id", "race_date", "track_code", "race_number"), "race_id").where("description <> ''")
    horse = F.when(F.col("program_number").isNotNull(), F.concat(F.lit("<b># "), "program_number", F.lit(" No Such Name</b> "))).otherwise("")
    said = F.concat(F.lit("Race "), F.col("race_number").cast("string"), F.lit(": "), horse, "description")
    items = c.select(F.col("change_id").alias("doc_id"), "track_code", said.alias("description"), F.lit(None).cast("string").alias("published"), "race_date").persist()
    low, high = items.agg(F.min("doc_id"), F.max("doc_id")).first()
    step = (high - low) // 2 + 1
    for k in range(2):  # in the order of their numbers
        items.where(F.col("doc_id").between(low + k * step, low + (k + 1) * step - 1)).coalesce(1).write.mode("append").parquet(f"{root}/landed")
    items.unpersist()
    stream = spark.readStream.schema(items.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/landed")
    ingest.stream_ingest(stream, f"{root}/store", f"{root}/checkpoint", {"availableNow": True}).awaitTermination()
    none = lambda n: F.lit(None).cast("string").alias(n)
    changes = ingest.read_store(spark, f"{root}/store", "changes").select(F.lit("change").alias("what"), F.col("race_id").alias("id"), "entry_id", F.col("change_type").alias("state"), none("post_time"), none("reason"))
    gone = ingest.read_store(spark, f"{root}/store", "entries").where("scratched").select(F.lit("scratched"), "entry_id", F.lit(None).cast("long"), none("a"), none("b"), none("c"))
    races = ingest.read_store(spark, f"{root}/store", "races").select(F.lit("race"), "race_id", F.lit(None).cast("long"), "race_status", "post_time", "cancellation_reason")
    return changes.union(gone).union(races)


@query("v_races", sql="""
  , n AS (SELECT race_id, purse, row_number() OVER (ORDER BY race_date DESC, race_id) AS pos, count(*) OVER () AS total FROM v_races)
  SELECT race_id, purse, pos, total FROM n WHERE pos <= 40 OR pos BETWEEN 361 AND 400 OR pos > (total - 1) // 40 * 40""")
def read_pages(r):
    """Pages of a written feed by its fences: the first, the tenth and the last."""
    path = tables.scratch_dir(r.spark)
    ordering.write_pages(r.races.select("race_id", "purse", "race_date"), [F.desc("race_date"), "race_id"], path, 1000)
    last = ordering.read_page(r.spark, path, 1, 40)[2]
    out = None
    for page in (1, 10, last):
        rows, total, _, _ = ordering.read_page(r.spark, path, page, 40)
        rows = rows.select("race_id", "purse", "pos", F.lit(total).cast("long").alias("total"))
        out = rows if out is None else out.union(rows)
    return out


@query("v_races", sql="SELECT race_id, track_code, race_number FROM v_races")
def scan_all(r):
    """The races through a database that Spark ships with, in parts of about as many rows."""
    url = f"jdbc:derby:memory:{uuid.uuid4().hex};create=true"
    options = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    rows = r.races.select(F.col("race_id").alias("RACE_ID"), F.col("track_code").alias("TRACK_CODE"), F.col("race_number").alias("RACE_NUMBER"))
    rows.write.option("createTableColumnTypes", "TRACK_CODE VARCHAR(20)").jdbc(url, "RACES", properties=options)
    return tables.scan_all(r.spark, url, "RACES", "RACE_ID", 6, **options).toDF("race_id", "track_code", "race_number")


@query("v_crawl_events", sql="""
  , e AS (SELECT feed, seen_at AS tm, kind = 'failure' AS bad, event_id FROM v_crawl_events), i AS (SELECT *, sum(CASE WHEN bad THEN 0 ELSE 1 END) OVER (PARTITION BY feed ORDER BY tm, event_id) AS island FROM e),
  n AS (SELECT *, row_number() OVER (PARTITION BY feed, island ORDER BY tm, event_id) AS k FROM i WHERE bad)
  SELECT n.feed, n.tm AS opened_at, f.tm AS resolved_at FROM n LEFT JOIN (SELECT feed, island - 1 AS island, tm FROM i WHERE NOT bad) f ON f.feed = n.feed AND f.island = n.island WHERE k = 2""")
def database_alerts(r):
    """A failure is an evaluation without connection; two in a row open an alert."""
    seen = r.crawl_events.select("feed", F.col("seen_at").alias("evaluated_at"), (F.col("kind") == "failure").alias("stale"))
    return health.stale_alerts(seen, health.DATABASE_STRIKES).select("feed", "opened_at", "resolved_at")
