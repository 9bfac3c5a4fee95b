"""State machines and order-dependent folds, in batch and as streams run to their end."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import functions as F

from ..operators import pacing
from ..operators.deal_machine import CLAIMED, NEW, USED, deal_events, deal_states
from ..sources.files import table, table_stream
from ..streaming.deals import STATE_STORE, deal_event_stream, hourly_health
from .registering import query
from .star import event_observations, shown_time


def _checkpoint(spark) -> str:
    """A fresh folder for a stream's progress, shared by all executors where the cluster names one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tidemark-stream-")
        atexit.register(shutil.rmtree, folder, True)
    return f"{folder}/stream-{uuid.uuid4().hex}"


def _run_to_end(stream, spark):
    """The rows of an available-now run in append mode, written to the shared folder."""
    where = _checkpoint(spark)
    running = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{where}/progress").trigger(availableNow=True).start(f"{where}/rows")
    running.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{where}/rows")


@contextlib.contextmanager
def _conf(spark, name: str, value: str):
    """A setting of the session for as long as the block runs."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


#: How late an observation may arrive, and so how far from the newest one the machine has come.
LATE_HOURS = 1
_RULES = ("n", "c", "u")
_NAMES = dict(zip(_RULES, (NEW, CLAIMED, USED)))
_DEAL = "STRUCT(st VARCHAR, seq VARCHAR, t BIGINT, price BIGINT, ref BIGINT, vkey VARCHAR, units BIGINT, via VARCHAR, ident VARCHAR, told BOOLEAN)"
_EVENT = "STRUCT(seq VARCHAR, t BIGINT, rule VARCHAR, event VARCHAR, status VARCHAR, reason VARCHAR, price BIGINT, ref BIGINT)"


def _bp(price: str, ref: str) -> str:
    """Basis points of a discount, halves away from zero."""
    return f"(CASE WHEN {price} IS NULL OR {ref} IS NULL OR {ref} <= 0 THEN 0 WHEN {price} <= {ref} THEN CAST(trunc(({ref} - {price}) * 10000.0::DOUBLE / {ref} + 0.5) AS BIGINT) ELSE -CAST(trunc(({price} - {ref}) * 10000.0::DOUBLE / {ref} + 0.5) AS BIGINT) END)"


def _machine_sql(micros: bool = False) -> str:
    """The deal machine as one recursive query over each offer's rows; the rules' parts are alike.

    Each offer's last row is a mark at the time up to which the machine has come, which only lets
    timers run out. Columns n, c and u are the open deals of the three rules. ``micros``: times as
    microseconds in ``us``.
    """
    minute, hour = 60_000_000, 3_600_000_000

    def event(seq: str, t: str, rule: str, name: str, status: str, reason: str, price: str, ref: str) -> str:
        return f"{{'seq': {seq}, 't': {t}, 'rule': '{_NAMES[rule]}', 'event': {name}, 'status': {status}, 'reason': {reason}, 'price': {price}, 'ref': {ref}}}::{_EVENT}"

    def changed(deal: str, **new: str) -> str:
        fields = ("st", "seq", "t", "price", "ref", "vkey", "units", "via", "ident", "told")
        return "{" + ", ".join(f"'{f}': {new.get(f, f'{deal}.{f}')}" for f in fields) + f"}}::{_DEAL}"

    timers, after_timers = [], []
    for x in _RULES:
        due = f"({x}.st = 'CONFIRMING' AND NOT {x}.told AND {x}.t + {10 * minute} < r.t)"
        dead, gone = f"({x}.st = 'CONFIRMING' AND {x}.t + {3 * hour} < r.t)", f"({x}.st = 'ACTIVE' AND f.last_ok + {24 * hour} < r.t)"
        timers += [
            f"CASE WHEN {due} THEN [{event(f'{x}.seq', f'{x}.t + {10 * minute}', x, chr(39) + 'confirm_due' + chr(39), chr(39) + 'CONFIRMING' + chr(39), 'NULL', f'{x}.price', f'{x}.ref')}] ELSE [] END",
            f"CASE WHEN {dead} THEN [{event(f'{x}.seq', f'{x}.t + {3 * hour}', x, chr(39) + 'rejected' + chr(39), chr(39) + 'REJECTED' + chr(39), chr(39) + 'confirm_deadline_missed' + chr(39), f'{x}.price', f'{x}.ref')}]"
            f" WHEN {gone} THEN [{event(f'{x}.seq', f'f.last_ok + {24 * hour}', x, chr(39) + 'expired' + chr(39), chr(39) + 'EXPIRED' + chr(39), chr(39) + 'not_observed' + chr(39), f'{x}.price', f'{x}.ref')}] ELSE [] END",
        ]
        after_timers.append(f"CASE WHEN coalesce({dead}, FALSE) OR coalesce({gone}, FALSE) THEN NULL WHEN {due} THEN {changed(x, told='TRUE')} ELSE {x} END AS {x}")
    refs = {"n": "verified", "c": "CASE WHEN verified IS NULL THEN nullif(claimed, 0) ELSE verified END", "u": "current_new"}
    current = {"n": "price", "c": "price", "u": "price + coalesce(shipping, 0)"}
    active = "CASE " + " ".join(f"WHEN {x}.st = 'ACTIVE' THEN '{x}'" for x in _RULES) + " END"

    def of(table: dict) -> str:
        return "CASE who " + " ".join(f"WHEN '{x}' THEN {table[x]}" for x in _RULES) + " END"

    too_soon = {x: f"({x}.st = 'CONFIRMING' AND {x}.seq <> seq AND t - {x}.t < {10 * minute})" for x in _RULES}
    ripe = {x: f"({x}.st = 'CONFIRMING' AND {x}.seq <> seq AND t - {x}.t >= {10 * minute})" for x in _RULES}
    verdicts = {}
    for x in _RULES:
        bp = _bp("price", f"({refs[x]})")
        verdicts[x] = f"""CASE WHEN {x}.via = 'DISCOVERY_GRID' AND page_type <> 'PRODUCT' THEN 'confirm_not_from_product_page'
          WHEN {x}.ident IS DISTINCT FROM ident THEN 'offer_identity_mismatch'
          WHEN {x}.vkey IS DISTINCT FROM vkey OR vkey IS DISTINCT FROM lkey OR {x}.units IS DISTINCT FROM units OR units IS DISTINCT FROM lunits THEN 'variant_mismatch'
          WHEN quality = 'REJECTED' THEN 'quality:rejected' WHEN quality = 'SUSPECT' AND other IS NOT NULL THEN 'quality:' || other
          WHEN price > {x}.price * 1.02::DOUBLE THEN 'price_changed' WHEN {bp} < 5000 THEN 'below_threshold_on_confirm'
          WHEN rkey <> coalesce(vkey, lkey) OR runits <> coalesce(units, lunits) OR grp <> 'NEW' THEN 'reference_scope_mismatch'
          WHEN price < floor THEN 'below_floor' WHEN {bp} > 9500 THEN 'implausible_discount' WHEN {bp} > 8500 THEN '+HELD_REVIEW' ELSE '+ACTIVE' END"""
    deep = lambda p, r: f"({r} - {p} >= 1000 AND {_bp(p, r)} >= 5000)"
    found = f"""CASE WHEN grp = 'NEW' AND cond = 'NEW' THEN CASE WHEN avail IN ('IN_STOCK', 'STORE_ONLY') AND {deep('price', 'verified')} THEN 'n'
        WHEN verified IS NULL AND clearance AND {deep('price', 'claimed')} THEN 'c' END
      WHEN cond = 'USED_GOOD' AND avail = 'IN_STOCK' AND {deep('(price + coalesce(shipping, 0))', 'current_new')} THEN 'u' END"""
    fields = "seq, t, snap, quality, other, via, page_type, ident, cond, grp, avail, clearance, price, shipping, claimed, verified, current_new, rkey, runits, vkey, units, lkey, lunits, floor"
    q = chr(39)
    recheck_event = event("seq", "t", "n", f"CASE WHEN lost IS NULL THEN 'refreshed' ELSE 'expired' END", f"CASE WHEN lost IS NULL THEN 'ACTIVE' ELSE 'EXPIRED' END", "lost", "cur", "ref").replace(f"'{_NAMES['n']}'", of({x: f"{q}{_NAMES[x]}{q}" for x in _RULES}))
    waiting = " || ".join(
        "CASE WHEN " + " AND ".join([f"coalesce({too_soon[x]}, FALSE)", *[f"NOT coalesce({ripe[y]}, FALSE)" for y in _RULES[: _RULES.index(x)]]]) + f" AND who IS NULL AND live AND price IS NOT NULL THEN [{event('seq', 't', x, q + 'waiting' + q, q + 'CONFIRMING' + q, q + 'confirm_too_soon' + q, 'price', refs[x])}] ELSE [] END"
        for x in _RULES
    )
    confirmer = "CASE WHEN who IS NULL AND live AND price IS NOT NULL THEN CASE " + " ".join(f"WHEN {ripe[x]} THEN '{x}'" for x in _RULES) + " END END"
    confirm_event = event("seq", "t", "n", "CASE WHEN starts_with(verdict, '+') THEN 'confirmed' ELSE 'rejected' END", "CASE WHEN starts_with(verdict, '+') THEN verdict[2:] ELSE 'REJECTED' END", "CASE verdict WHEN '+ACTIVE' THEN NULL WHEN '+HELD_REVIEW' THEN 'discount_85_to_95' ELSE verdict END", "price", of(refs).replace("CASE who", "CASE conf")).replace(
        f"'{_NAMES['n']}'", of({x: f"{q}{_NAMES[x]}{q}" for x in _RULES}).replace("CASE who", "CASE conf")
    )
    after = []
    for x in _RULES:
        made = "{" + f"'st': 'CONFIRMING', 'seq': seq, 't': t, 'price': {current[x]}, 'ref': {dict(n='verified', c='claimed', u='current_new')[x]}, 'vkey': vkey, 'units': units, 'via': via, 'ident': ident, 'told': FALSE" + f"}}::{_DEAL}"
        after.append(
            f"CASE WHEN who = '{x}' THEN CASE WHEN lost IS NULL THEN {changed(x, price='cur', ref='ref')} END WHEN conf = '{x}' THEN CASE WHEN starts_with(verdict, '+') THEN {changed(x, st='verdict[2:]', price='price', ref=f'coalesce({refs[x]}, {x}.ref)')} END"
            f" WHEN made = '{x}' THEN {made} ELSE {x} END AS {x}"
        )
    detect_events = " || ".join(f"CASE WHEN made = '{x}' THEN [{event('seq', 't', x, q + 'detected' + q, q + 'CONFIRMING' + q, 'NULL', current[x], dict(n='verified', c='claimed', u='current_new')[x])}] ELSE [] END" for x in _RULES)
    return f"""WITH RECURSIVE e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events), mark AS (SELECT (epoch_us(max(ts)) // 1000 - {LATE_HOURS * 3_600_000}) * 1000 AS t FROM events),
    obs AS (
      SELECT user_id AS offer_id, lpad(CAST(event_id AS VARCHAR), 12, '0') AS seq, epoch_us(ts) AS t,
        CASE event_id % 4 WHEN 0 THEN 's' || k WHEN 1 THEN '' ELSE CAST(event_id AS VARCHAR) END AS snap, CASE WHEN event_id % 41 = 0 THEN 'REJECTED' WHEN event_type = 'error' THEN 'SUSPECT' ELSE 'OK' END AS quality,
        CASE WHEN event_type = 'error' AND event_id % 2 = 0 THEN 'out_of_band' END AS other, CASE WHEN event_id % 5 = 0 THEN 'DISCOVERY_GRID' ELSE 'PRODUCT_PAGE' END AS via,
        CASE WHEN event_id % 7 = 0 THEN 'CLEARANCE_LISTING' ELSE 'PRODUCT' END AS page_type, CASE WHEN event_id % 29 = 0 THEN 'b' ELSE 'a' END AS ident,
        CASE WHEN user_id % 5 = 0 THEN 'USED_GOOD' ELSE 'NEW' END AS cond, CASE WHEN user_id % 5 = 0 THEN 'USED' ELSE 'NEW' END AS grp,
        CASE WHEN event_type = 'purchase' AND event_id % 3 = 0 THEN 'OUT_OF_STOCK' WHEN event_id % 6 = 0 THEN 'STORE_ONLY' ELSE 'IN_STOCK' END AS avail, event_id % 3 <> 0 AS clearance,
        CASE WHEN event_id % 53 <> 0 THEN CAST(round(value * 100) AS BIGINT) END AS price, CASE WHEN k % 2 = 0 THEN k END AS shipping, k * 100 AS claimed,
        CASE WHEN user_id % 3 <> 0 AND event_id % 47 <> 0 THEN 6000::BIGINT END AS verified, 5000::BIGINT AS current_new, CASE WHEN user_id % 31 = 0 THEN 'z' END AS rkey, CASE WHEN user_id % 37 = 0 THEN 5::BIGINT END AS runits,
        CASE WHEN event_id % 19 = 0 THEN 'other' ELSE 'k' END AS vkey, CASE WHEN event_id % 23 = 0 THEN 2::BIGINT WHEN user_id % 37 = 0 THEN 3::BIGINT END AS units, 'k' AS lkey, CASE WHEN user_id % 37 = 0 THEN 3::BIGINT END AS lunits, 400::BIGINT AS floor
      FROM e WHERE epoch_us(ts) < (SELECT t FROM mark)
    ), r AS (
      SELECT *, row_number() OVER (PARTITION BY offer_id ORDER BY t, seq) AS k FROM (SELECT * FROM obs UNION ALL BY NAME SELECT DISTINCT offer_id, (SELECT t FROM mark) AS t, '~' AS seq FROM obs)
    ), f AS (
      SELECT DISTINCT offer_id, 0::BIGINT AS k, NULL::BIGINT AS last_ok, []::STRUCT(ref VARCHAR, t BIGINT)[] AS seen, NULL::{_DEAL} AS n, NULL::{_DEAL} AS c, NULL::{_DEAL} AS u, []::{_EVENT}[] AS told FROM obs
      UNION ALL
      SELECT offer_id, k, ok_at, seen, {", ".join(after)}, told || {detect_events} AS told FROM (
        SELECT *, CASE WHEN who IS NULL AND conf IS NULL AND live AND quality = 'OK' AND price IS NOT NULL THEN CASE found {" ".join(f"WHEN '{x}' THEN CASE WHEN {x} IS NULL THEN '{x}' END" for x in _RULES)} END END AS made FROM (
          SELECT * REPLACE (told || CASE WHEN conf IS NOT NULL THEN [{confirm_event}] ELSE [] END AS told) FROM (
            SELECT *, CASE conf {" ".join(f"WHEN '{x}' THEN {verdicts[x]}" for x in _RULES)} END AS verdict FROM (
              SELECT * REPLACE (told || CASE WHEN who IS NOT NULL THEN [{recheck_event}] ELSE [] END || {waiting} AS told), {confirmer} AS conf, {found} AS found FROM (
                SELECT *, CASE WHEN who IS NULL THEN NULL WHEN avail NOT IN ('IN_STOCK', 'STORE_ONLY') THEN 'sold_out' WHEN ref IS NULL OR ref <= 0 THEN 'reference_lost' WHEN cur > {of({x: f"{x}.price" for x in _RULES})} * 1.02::DOUBLE OR {_bp("cur", "ref")} < 5000 THEN 'price_recovered' END AS lost FROM (
                  SELECT *, {of(current)} AS cur, {of(refs)} AS ref FROM (
                    SELECT *, CASE WHEN live AND quality = 'OK' AND price IS NOT NULL THEN {active} END AS who, CASE WHEN live AND quality = 'OK' THEN t ELSE last_ok END AS ok_at FROM (
                      SELECT f.offer_id, r.k, f.last_ok, {", ".join(f"r.{x.strip()}" for x in fields.split(","))}, {" || ".join(timers)} AS told, {", ".join(after_timers)},
                        r.seq <> '~' AND NOT coalesce(r.snap <> '' AND list_contains(list_transform(list_filter(f.seen, lambda s: r.t - s.t <= {168 * hour}), lambda s: s.ref), r.snap), FALSE) AS live,
                        CASE WHEN r.snap <> '' AND NOT list_contains(list_transform(list_filter(f.seen, lambda s: r.t - s.t <= {168 * hour}), lambda s: s.ref), r.snap)
                          THEN list_append(list_filter(f.seen, lambda s: r.t - s.t <= {168 * hour}), {{'ref': r.snap, 't': r.t}}) ELSE list_filter(f.seen, lambda s: r.t - s.t <= {168 * hour}) END AS seen
                      FROM f JOIN r ON r.offer_id = f.offer_id AND r.k = f.k + 1))))))))
    ) SELECT offer_id, x.seq AS seq, {"x.t AS us" if micros else "strftime(make_timestamp(x.t), '%Y-%m-%d %H:%M:%S') AS observed_at"}, x.rule AS rule, x.event AS event, x.status AS status, x.reason AS reason, x.price AS price_cents, x.ref AS reference_cents, {_bp("x.price", "x.ref")} AS discount_bp
    FROM (SELECT offer_id, unnest(told) AS x FROM f)"""


def _reached(spark, sf_dir) -> int:
    """The watermark once all events are read: the newest one less the lateness, in whole milliseconds, as microseconds."""
    newest = table(spark, sf_dir, "events").agg(F.unix_millis(F.max(F.col("ts").cast("timestamp")))).first()[0]
    return (newest - LATE_HOURS * 3_600_000) * 1000


@query(_machine_sql())
def deal_fsm_batch(spark, sf_dir):
    """All that happens to deals up to the time that the stream reaches."""
    return deal_events(event_observations(spark, sf_dir), until=_reached(spark, sf_dir)).withColumn("observed_at", shown_time(F.col("observed_at")))


def _event_stream(spark, sf_dir):
    """The events table as a stream."""
    return table_stream(spark, sf_dir, "events")


class _Streaming:
    """A session whose tables are streams, for functions that read by ``table``."""

    def __init__(self, spark):
        self.read = self
        self.spark = spark

    def parquet(self, path: str):
        return _event_stream(self.spark, path.rsplit("/", 1)[0])


STATES = f"""SELECT offer_id, rule, CAST(number AS BIGINT) AS number, min(seq) FILTER (WHERE event = 'detected') AS detected_seq, last(status ORDER BY us) AS status, last(reason ORDER BY us) FILTER (WHERE event IN ('confirmed', 'rejected', 'expired')) AS reason,
  last(price_cents ORDER BY us) FILTER (WHERE event IN ('detected', 'confirmed', 'refreshed')) AS price_cents, last(reference_cents ORDER BY us) FILTER (WHERE event IN ('detected', 'confirmed', 'refreshed')) AS reference_cents,
  strftime(make_timestamp(min(us)), '%Y-%m-%d %H:%M:%S') AS detected_at, strftime(make_timestamp(min(us) FILTER (WHERE event = 'confirmed')), '%Y-%m-%d %H:%M:%S') AS confirmed_at,
  strftime(make_timestamp(max(us) FILTER (WHERE status IN ('REJECTED', 'EXPIRED'))), '%Y-%m-%d %H:%M:%S') AS closed_at, count(*) FILTER (WHERE event = 'refreshed') AS refreshes
FROM (SELECT *, sum(CASE WHEN event = 'detected' THEN 1 ELSE 0 END) OVER (PARTITION BY offer_id, rule ORDER BY us) AS number FROM ({_machine_sql(micros=True)})) GROUP BY offer_id, rule, number"""


@query(STATES)
def deal_states_after_events(spark, sf_dir):
    """Deals as they stand when the machine has come to its end."""
    made = deal_states(deal_events(event_observations(spark, sf_dir), until=_reached(spark, sf_dir)))
    return made.withColumns({c: shown_time(F.col(c)) for c in ("detected_at", "confirmed_at", "closed_at")})


@query(_machine_sql())
def deal_fsm_stream(spark, sf_dir):
    """The same events as ``deal_fsm_batch``, from the stream."""
    rows = event_observations(_Streaming(spark), sf_dir)
    with _conf(spark, *STATE_STORE):
        return _run_to_end(deal_event_stream(rows, f"{LATE_HOURS} hour"), spark).withColumn("observed_at", shown_time(F.col("observed_at")))


@query(
    """SELECT strftime(hour, '%Y-%m-%d %H:%M:%S') AS hour, retailer_id, fetched, blocked FROM (
      SELECT date_trunc('hour', ts) AS hour, user_id % 5 AS retailer_id, count(*) AS fetched, count(*) FILTER (WHERE event_type = 'error') AS blocked FROM events GROUP BY 1, 2)
    WHERE hour + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR"""
)
def hourly_health_stream(spark, sf_dir):
    """Hours that the watermark has closed by the end of the data."""
    events = _event_stream(spark, sf_dir)
    rows = events.select(F.col("ts").cast("timestamp").alias("at"), (F.col("user_id") % 5).alias("retailer_id"), (F.col("event_type") == "error").alias("blocked"))
    done = _run_to_end(hourly_health(rows), spark)
    return done.withColumn("hour", shown_time(F.col("hour")))


@query(
    """WITH RECURSIVE r AS (
      SELECT user_id, event_id, epoch(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events
    ), f AS (
      SELECT user_id, event_id, t, k, [t] AS kept, TRUE AS admitted FROM r WHERE k = 1
      UNION ALL
      SELECT r.user_id, r.event_id, r.t, r.k,
        CASE WHEN len(list_filter(f.kept, lambda x: x > r.t - 172800)) < 5 THEN list_append(list_filter(f.kept, lambda x: x > r.t - 172800), r.t) ELSE list_filter(f.kept, lambda x: x > r.t - 172800) END,
        len(list_filter(f.kept, lambda x: x > r.t - 172800)) < 5
      FROM f JOIN r ON r.user_id = f.user_id AND r.k = f.k + 1
    ) SELECT user_id AS client, event_id AS seq, admitted FROM f"""
)
def rate_limit_fold(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("client"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("at"))
    return pacing.limit_requests(rows, 5, 172800.0).select("client", "seq", "admitted")


def _trip(row: str, recent: str, open_until: str, t: str) -> str:
    return f"(({row} >= 5 OR len({recent}) >= 20 AND list_sum({recent}) / len({recent})::DOUBLE > 0.20::DOUBLE) AND ({open_until} IS NULL OR {t} >= {open_until}))"


BREAKER = f"""WITH RECURSIVE r AS (
  SELECT user_id % 50 AS retailer_id, ts, epoch_us(ts) AS t, event_type IN ('error', 'signup') AS blocked, row_number() OVER (PARTITION BY user_id % 50 ORDER BY ts, event_id) AS n FROM events
), f AS (
  SELECT DISTINCT retailer_id, 0::BIGINT AS n, NULL::TIMESTAMP AS ts, 0 AS row, []::INTEGER[] AS recent, NULL::BIGINT AS open_until, []::BIGINT[] AS trips, FALSE AS disabled, NULL::VARCHAR AS cause FROM r
  UNION ALL
  SELECT retailer_id, n, ts, CASE WHEN trip THEN 0 ELSE row END, recent, CASE WHEN trip THEN t + 43200000000 ELSE open_until END,
    CASE WHEN trip THEN after ELSE trips END, disabled OR trip AND len(after) >= 2, CASE WHEN trip THEN CASE WHEN row >= 5 THEN 'run' ELSE 'rate' END END FROM (
    SELECT *, {_trip("row", "recent", "open_until", "t")} AS trip, list_append(list_filter(trips, lambda x: t - x < 172800000000), t) AS after FROM (
      SELECT f.retailer_id, r.n, r.ts, r.t, CASE WHEN r.blocked THEN f.row + 1 ELSE 0 END AS row, list_append(f.recent, CASE WHEN r.blocked THEN 1 ELSE 0 END)[-20:] AS recent, f.open_until, f.trips, f.disabled
      FROM f JOIN r ON r.retailer_id = f.retailer_id AND r.n = f.n + 1))
) SELECT retailer_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, cause, disabled FROM f WHERE cause IS NOT NULL"""


@query(BREAKER)
def breaker_trips(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 50).alias("retailer_id"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("at"), F.col("event_type").isin("error", "signup").alias("blocked"))
    return pacing.breaker_events(rows).withColumn("at", shown_time(F.col("at")))


LADDER = f"""WITH RECURSIVE r AS (
  SELECT user_id % 25 AS retailer_id, event_id AS seq, epoch_us(ts) AS t, event_type = 'purchase' AS reserve, event_type = 'error' AND event_id % 4 < 3 AS blocked,
    row_number() OVER (PARTITION BY user_id % 25 ORDER BY ts, event_id) AS n FROM events
), f AS (
  SELECT DISTINCT retailer_id, 0::BIGINT AS n, 0::BIGINT AS seq, NULL::BIGINT AS last, NULL::BIGINT AS hour, NULL::BIGINT AS day, 0 AS in_hour, 0 AS in_day,
    0 AS row, []::INTEGER[] AS recent, NULL::BIGINT AS open_until, []::BIGINT[] AS trips, FALSE AS disabled, ''::VARCHAR AS verdict FROM r
  UNION ALL
  SELECT retailer_id, n, seq, CASE WHEN ok THEN t ELSE last END, hour, day, in_hour + CASE WHEN ok THEN 1 ELSE 0 END, in_day + CASE WHEN ok THEN 1 ELSE 0 END,
    CASE WHEN ok AND trip THEN 0 WHEN ok THEN row_after ELSE row END, CASE WHEN ok THEN recent_after ELSE recent END, CASE WHEN ok AND trip THEN t + 43200000000 ELSE open_until END,
    CASE WHEN ok AND trip THEN trips_after ELSE trips END, disabled OR ok AND trip AND len(trips_after) >= 2, verdict FROM (
    SELECT *, verdict = 'ok' AS ok, {_trip("row_after", "recent_after", "open_until", "t")} AS trip FROM (
      SELECT *, list_append(list_filter(trips, lambda x: t - x < 172800000000), t) AS trips_after,
        CASE WHEN disabled THEN 'disabled' WHEN t < open_until THEN 'breaker_open' WHEN t - last < 600000000 THEN 'delay' WHEN in_hour >= 2 THEN 'hourly'
          WHEN in_day >= CASE WHEN reserve THEN 10 ELSE 7 END THEN 'daily' ELSE 'ok' END AS verdict FROM (
        SELECT f.retailer_id, r.n, r.seq, r.t, r.reserve, f.last, CASE WHEN f.hour IS NULL OR r.t - f.hour >= 3600000000 THEN r.t ELSE f.hour END AS hour, CASE WHEN f.day IS NULL OR r.t - f.day >= 86400000000 THEN r.t ELSE f.day END AS day,
          CASE WHEN f.hour IS NULL OR r.t - f.hour >= 3600000000 THEN 0 ELSE f.in_hour END AS in_hour, CASE WHEN f.day IS NULL OR r.t - f.day >= 86400000000 THEN 0 ELSE f.in_day END AS in_day,
          f.row, CASE WHEN r.blocked THEN f.row + 1 ELSE 0 END AS row_after, f.recent, list_append(f.recent, CASE WHEN r.blocked THEN 1 ELSE 0 END)[-20:] AS recent_after, f.open_until, f.trips, f.disabled
        FROM f JOIN r ON r.retailer_id = f.retailer_id AND r.n = f.n + 1)))
) SELECT retailer_id, seq, verdict FROM f WHERE n > 0"""


@query(LADDER)
def admission_ladder(spark, sf_dir):
    """Verdicts of the whole ladder, its budgets scaled to the density of the events; what is let through
    and blocked opens the breaker."""
    kind = F.when(F.col("event_type") == "purchase", "CONFIRM").otherwise("ENROLL")
    blocked = (F.col("event_type") == "error") & (F.col("event_id") % 4 < 3)
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 25).alias("retailer_id"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("at"), kind.alias("kind"), blocked.alias("blocked"))
    return pacing.admit_requests(rows, pacing.Budget(min_delay=600, per_hour=2, per_day=10)).select("retailer_id", "seq", "verdict")
