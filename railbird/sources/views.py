"""Racing tables made from general order, item and event tables.

The SQL is valid for Spark and for other engines; ``{orders}`` and the like stand for the
source tables.  Cards are a nation's orders of a month, entries its items, changes its events.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

AS_OF_DATE = "1998-06-01"
AS_OF_TS = "1998-06-01 19:00:00"
EVENTS_AS_OF = "2024-01-20 12:00:00"
SOURCES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

_PAD2 = "lpad(cast({0} as varchar(9)), 2, '0')"
_CENTS = "cast(concat(cast(cast(floor({0} / 100) as bigint) as varchar(20)), '.', lpad(cast({0} % 100 as varchar(9)), 2, '0')) as decimal(10,2))"


def _pad2(x: str) -> str:
    return _PAD2.replace("{0}", x)


def _cents(x: str) -> str:
    return _CENTS.replace("{0}", x)


VIEWS = {
    "v_tracks": f"""
        SELECT concat('T', {_pad2("n_nationkey")}) AS track_code, n_name AS track_name,
               CASE n_regionkey WHEN 0 THEN 'America/New_York' WHEN 1 THEN 'America/Chicago' WHEN 2 THEN 'America/Denver'
                                WHEN 3 THEN 'America/Los_Angeles' ELSE 'America/Phoenix' END AS timezone
        FROM {{nation}}""",
    "v_races": f"""
        SELECT race_id, concat(track_code, '-', cast(year(race_date) as varchar(4)), {_pad2("month(race_date)")}, '01-', cast(race_number as varchar(9))) AS race_key,
               track_code, race_date, race_number,
               CASE WHEN race_id % 11 = 0 THEN cast(null as varchar(9)) ELSE concat({_pad2("12 + race_number % 9")}, ':', {_pad2("race_number * 7 % 60")}, ':00') END AS post_time,
               CASE race_id % 4 WHEN 0 THEN 'Allowance' WHEN 1 THEN 'Claiming' WHEN 2 THEN 'Maiden' ELSE 'Stakes' END AS race_type,
               CASE race_id % 3 WHEN 0 THEN 'Dirt' WHEN 1 THEN 'Turf' ELSE 'Synthetic' END AS surface,
               CASE race_id % 5 WHEN 0 THEN '6F' WHEN 1 THEN '1 1/8 Miles' WHEN 2 THEN '350 Yards' WHEN 3 THEN '1 MILE' ELSE '7 Furlongs' END AS distance,
               concat('$', cast(cast(floor(price) as bigint) as varchar(20))) AS purse,
               CASE WHEN state = 'F' THEN 'completed' WHEN priority = '5-LOW' THEN 'cancelled' WHEN state = 'O' THEN 'upcoming' ELSE 'past_drf_only' END AS race_status,
               state <> 'F' AND priority = '5-LOW' AS is_cancelled,
               CASE WHEN state <> 'F' AND priority = '5-LOW' THEN 'Weather' END AS cancellation_reason,
               CASE WHEN state = 'F' AND race_id % 13 = 0 THEN '9' END AS winner_program_number
        FROM (
          SELECT *, cast(row_number() OVER (PARTITION BY track_code, race_date ORDER BY ordered, race_id) as int) AS race_number
          FROM (SELECT o_orderkey AS race_id, concat('T', {_pad2("c_nationkey")}) AS track_code, cast(date_trunc('month', o_orderdate) as date) AS race_date,
                       o_orderdate AS ordered, o_orderstatus AS state, o_orderpriority AS priority, o_totalprice AS price
                FROM {{orders}} JOIN {{customer}} ON o_custkey = c_custkey) dated) cards""",
    "v_entries_raw": """
        SELECT l_orderkey AS race_id, l_linenumber AS line, l_partkey AS horse_id, l_suppkey AS jockey_id, l_orderkey % 97 AS trainer_id,
               l_extendedprice AS price, l_discount AS discount, l_returnflag AS flag, l_shipdate AS shipped
        FROM {lineitem}""",
    "v_entries": f"""
        SELECT e.race_id * 10 + e.line AS entry_id, e.race_id, cast(e.line as varchar(9)) AS program_number, e.horse_id, e.jockey_id, e.trainer_id, e.flag = 'R' AS scratched,
               e.price, e.discount, e.place AS finish_position,
               CASE WHEN e.place = 1 THEN {_cents("(cast(floor(e.price) as bigint) % 3000 + 220)")} END AS win_payout,
               CASE WHEN e.place <= 2 THEN {_cents("(cast(floor(e.price) as bigint) % 1500 + 210)")} END AS place_payout,
               CASE WHEN e.place <= 3 THEN {_cents("(cast(floor(e.price) as bigint) % 700 + 200)")} END AS show_payout
        FROM (
          SELECT c.*, CASE WHEN r.o_orderstatus = 'F' AND c.flag <> 'R'
                      THEN cast(row_number() OVER (PARTITION BY c.race_id ORDER BY c.flag = 'R', c.price DESC, c.line) as int) END AS place
          FROM (SELECT *, lag(line) OVER (PARTITION BY race_id ORDER BY line, shipped DESC, price DESC, horse_id DESC, jockey_id DESC) AS before FROM v_entries_raw) c
          JOIN {{orders}} r ON r.o_orderkey = c.race_id
          WHERE c.before IS NULL OR c.before <> c.line) e""",
    "v_horses": "SELECT p_partkey AS horse_id, p_name AS horse_name, p_size AS foaling_year FROM {part}",
    "v_jockeys": "SELECT s_suppkey AS jockey_id, s_name AS jockey_name FROM {supplier}",
    "v_changes": f"""
        SELECT e.event_id AS change_id, r.race_id, en.entry_id,
               CASE WHEN e.event_type IN ('error', 'click') THEN cast(e.user_id % 7 + 1 as varchar(9)) END AS program_number,
               CASE e.event_type WHEN 'error' THEN 'Scratch' WHEN 'click' THEN 'Jockey Change' WHEN 'view' THEN 'Other' WHEN 'signup' THEN 'Race Cancelled' ELSE 'Post Time Change' END AS change_type,
               CASE e.event_type
                 WHEN 'error' THEN CASE WHEN e.user_id % 3 = 0 THEN 'Scratched - Reason Unavailable' ELSE concat('Scratched - Vet ', cast(e.user_id % 10 as varchar(9))) END
                 WHEN 'click' THEN concat('Jockey changed to Rider ', cast(e.user_id as varchar(9)))
                 WHEN 'view' THEN CASE WHEN e.user_id % 4 = 0 THEN '' WHEN e.user_id % 4 = 1 THEN 'Show Wagering Cancelled' WHEN e.user_id % 4 = 2 THEN 'Scratch Reason changed to Injured' ELSE 'Track condition fast' END
                 WHEN 'signup' THEN CASE WHEN e.user_id % 2 = 0 THEN 'Race Cancelled - Weather' ELSE 'Pick 5 Pool Cancelled' END
                 ELSE concat('Post Time changed to ', cast(e.user_id % 12 + 1 as varchar(9)), ':', {_pad2("e.user_id % 60")}, ' PM') END AS description,
               e.ts AS created_at
        FROM (SELECT e.*, e.event_id % (SELECT count(*) FROM {{orders}}) + (SELECT min(o_orderkey) FROM {{orders}}) AS race FROM {{events}} e) e
        JOIN v_races r ON r.race_id = e.race
        LEFT JOIN v_entries en ON en.race_id = r.race_id AND e.event_type IN ('error', 'click') AND en.program_number = cast(e.user_id % 7 + 1 as varchar(9))""",
    "v_claims": f"""
        SELECT e.entry_id AS claim_id, e.race_id, e.program_number, e.horse_id,
               CASE WHEN e.entry_id % 5 = 0 THEN cast(null as varchar(20)) ELSE concat('Trainer ', cast(e.jockey_id as varchar(9))) END AS new_trainer_name,
               CASE WHEN e.entry_id % 7 = 0 THEN '' ELSE concat('Owner ', cast(e.trainer_id as varchar(9))) END AS new_owner_name,
               {_cents("(cast(floor(e.price) as bigint) * 10)")} AS claim_price
        FROM v_entries e WHERE e.discount >= 0.08""",
    "v_exotics": f"""
        SELECT r.race_id, w.seq, w.wager_type, {_cents("(r.race_id % 9000 + 1000 * w.seq)")} AS payout
        FROM v_races r JOIN (SELECT 1 AS seq, '$2 Exacta' AS wager_type UNION ALL SELECT 2, '$1 Trifecta' UNION ALL SELECT 3, '50c Trifecta') w ON r.race_id % (w.seq + 1) = 0
        WHERE r.race_status = 'completed'""",
    "v_bets": f"""
        SELECT e.event_id AS bet_id, r.race_id, cast(e.user_id % 7 + 1 as varchar(9)) AS horse_number, e.user_id AS wallet_id,
               CASE e.event_id % 10 WHEN 0 THEN 'Win' WHEN 1 THEN 'Place' WHEN 2 THEN 'Show' WHEN 3 THEN 'WPS' WHEN 4 THEN 'Win Place' WHEN 5 THEN 'Place Show'
                                   WHEN 6 THEN 'Exacta Box' WHEN 7 THEN 'Trifecta Box' WHEN 8 THEN 'Exacta Key' ELSE 'Trifecta' END AS bet_type,
               cast(e.user_id % 5 + 1 as decimal(10,2)) AS bet_amount,
               CASE WHEN e.event_id % 10 IN (6, 7) THEN concat('["', cast(e.user_id % 3 + 1 as varchar(9)), '","', cast(e.user_id % 3 + 2 as varchar(9)), '","', cast(e.user_id % 2 + 4 as varchar(9)), '"]')
                    WHEN e.event_id % 10 = 8 THEN concat('[["', cast(e.user_id % 4 + 1 as varchar(9)), '"],["1","2","', cast(e.user_id % 2 + 3 as varchar(9)), '"]]')
                    WHEN e.event_id % 10 = 9 THEN concat('[["', cast(e.user_id % 3 + 1 as varchar(9)), '"],["1","2","3"],["1","2","3","4"]]') END AS selection,
               'Pending' AS status, e.ts AS created_at
        FROM (SELECT e.*, (e.event_id * 7) % (SELECT count(*) FROM {{orders}}) + (SELECT min(o_orderkey) FROM {{orders}}) AS race FROM {{events}} e) e
        JOIN v_races r ON r.race_id = e.race""",
    "v_crawl_events": """
        SELECT event_id, CASE user_id % 3 WHEN 0 THEN 'entries' WHEN 1 THEN 'results' ELSE 'scratches' END AS feed,
               CASE WHEN event_type = 'signup' THEN 'signal' WHEN event_type = 'error' OR value < 20 THEN 'failure' WHEN event_type = 'view' THEN 'attempt' ELSE 'success' END AS kind,
               ts AS seen_at, CASE user_id % 4 WHEN 0 THEN 'rss' WHEN 1 THEN 'direct' WHEN 2 THEN 'mobile' ELSE 'index' END AS source
        FROM {events}""",
}


def needed(names: tuple[str, ...]) -> list[str]:
    """The views ``names`` and those that they read, in the order of ``VIEWS``."""
    want = set(names)
    for view in reversed(list(VIEWS)):
        if view in want:
            want |= {v for v in VIEWS if v != view and v in VIEWS[view].replace("v_entries_raw", "@" if view != "v_entries" else "v_entries_raw")}
    return [v for v in VIEWS if v in want]


def cte(*names: str) -> str:
    """'WITH v_… AS (…), …' for engines that have the source tables under their own names."""
    tables = {t: t for t in SOURCES}
    return "WITH " + ",\n".join(f"{v} AS ({VIEWS[v].format(**tables)})" for v in needed(names))


_NAMED = re.compile(r"\bv_\w+\b")


class Racing:
    """The views of one data set, by attribute: ``Racing(spark, dir).races``.  Each is analysed once, over the ones it reads."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self._known = spark, sf_dir, {}

    def source(self, name: str) -> DataFrame:
        """A source table, whose files are listed once."""
        if name not in self._known:
            self._known[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._known[name]

    def over(self, **views: DataFrame) -> Racing:
        """The same data set, with some views, by attribute, as a job has stored them; other views read these."""
        other = Racing(self.spark, self.sf_dir)
        other._known |= {f"v_{n}": df for n, df in views.items()}
        return other

    def __getattr__(self, name: str) -> DataFrame:
        view = f"v_{name}"
        if name.startswith("_") or view not in VIEWS:
            raise AttributeError(name)
        if view not in self._known:
            text = _NAMED.sub(lambda m: "{" + m[0] + "}", VIEWS[view])
            used = {t: self.source(t) for t in SOURCES if "{" + t + "}" in text} | {v: getattr(self, v[2:]) for v in set(_NAMED.findall(VIEWS[view]))}
            for varchar in ("varchar(4)", "varchar(9)", "varchar(20)"):
                text = text.replace(varchar, "string")
            self._known[view] = self.spark.sql(text, **used)
        return self._known[view]
