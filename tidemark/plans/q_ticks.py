"""Sweeps of pages, and ticks that judge bare rows by what keyed state remembers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import guards, sweeps
from ..sources.files import table
from ..streaming.deals import STATE_STORE
from ..streaming.ticks import start_ticks, stored
from .q_stateful import _checkpoint, _conf, _event_stream
from .registering import query
from .star import GAP_SECONDS, OBSERVATIONS, SWEEPS, observations, on_pages


@query(f"WITH {OBSERVATIONS}, {SWEEPS} SELECT page_key, sweep, variants, prices, previous_variants, previous_prices FROM counts")
def sweep_counts(spark, sf_dir):
    rows = on_pages(observations(spark, sf_dir))
    times = sweeps.sessions(rows, GAP_SECONDS)
    placed = rows.join(sweeps.looked_up(times, times), ["page_key", "observed_at"])
    return sweeps.counted_sweeps(placed)


def bare_events(spark, events):
    """events as bare observations of pages that are swept once a day."""
    ts, event, user = F.col("ts").cast("timestamp"), F.col("event_id"), F.col("user_id")
    k, day = F.get_json_object("props", "$.k").cast("bigint"), F.datediff(F.col("ts"), F.lit("2024-01-01")).cast("bigint")
    return events.select(
        user.alias("offer_id"), F.lpad(event.cast("string"), 12, "0").alias("seq"), ts.alias("observed_at"),
        F.when(event % 4 == 0, F.concat(F.lit("s"), k.cast("string"))).when(event % 4 == 1, "").when(event % 4 == 2, event.cast("string")).alias("snapshot_ref"),
        F.when(event % 97 != 0, F.concat(F.lit("p"), (user % 20).cast("string"))).alias("page_key"), day.alias("sweep"),
        F.concat(F.lit("v"), (k % F.when(day % 3 == 0, 3).otherwise(40)).cast("string")).alias("variant_key"), F.when(event % 61 == 0, "v0").alias("listing_variant_key"),
        F.when((user % 20 == 7) & (day % 4 == 0), 5000).otherwise(F.round(F.col("value") * 100)).cast("bigint").alias("price_cents"),
        F.when(event % 71 == 0, "CAD").otherwise("USD").alias("currency"), F.lit(200).cast("bigint").alias("band_floor"), F.lit(30000).cast("bigint").alias("band_ceiling"),
        (event % 3 != 0).alias("on_clearance"), (k * 100).alias("claimed_cents"), F.nullif(event % 4, F.lit(0).cast("bigint")).alias("unit_count"), F.when(event % 5 == 0, F.lit(2).cast("bigint")).alias("listing_unit_count"),
        F.when(event % 43 != 0, "NEW").alias("condition"), F.lit("new").alias("wording"), (event % 86 == 0).alias("used_page"),
    )


_LAST = "CASE WHEN f.ok THEN f.price ELSE f.last END"
TICKS = f"""WITH RECURSIVE e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS day FROM events), b AS (
  SELECT user_id AS offer_id, lpad(CAST(event_id AS VARCHAR), 12, '0') AS seq, epoch_us(ts) AS t, CASE event_id % 4 WHEN 0 THEN 's' || k WHEN 1 THEN '' WHEN 2 THEN CAST(event_id AS VARCHAR) END AS snap,
    CASE WHEN event_id % 97 <> 0 THEN user_id % 20 END AS page, day, 'v' || (k % CASE WHEN day % 3 = 0 THEN 3 ELSE 40 END) AS vkey, CASE WHEN event_id % 61 = 0 THEN 'v0' END AS lkey,
    CASE WHEN user_id % 20 = 7 AND day % 4 = 0 THEN 5000 ELSE CAST(round(value * 100) AS BIGINT) END AS price, event_id % 71 = 0 AS foreign_money, event_id % 3 <> 0 AS clearance, k * 100 AS claimed,
    nullif(event_id % 4, 0) AS units, CASE WHEN event_id % 5 = 0 THEN 2 END AS lunits, event_id % 43 = 0 AND event_id % 86 <> 0 AS odd FROM e
), c AS (SELECT page, day, count(DISTINCT vkey) AS variants, count(DISTINCT price) AS prices FROM b WHERE page IS NOT NULL GROUP BY 1, 2
), l AS (SELECT *, lag(variants) OVER w AS pv, lag(prices) OVER w AS pp FROM c WINDOW w AS (PARTITION BY page ORDER BY day)
), o AS (
  SELECT *, row_number() OVER (PARTITION BY offer_id ORDER BY t, seq) AS n FROM (
    SELECT b.*, variants, prices, pv, pp,
      CASE WHEN price <= 0 OR foreign_money THEN 'invalid_price_or_currency' END AS bad, price < 200 OR price > 30000 AS band, clearance AND claimed <= price AS claim, coalesce(vkey <> lkey, FALSE) AS changed,
      coalesce(pv > 0 AND (variants < 0.5::DOUBLE * pv OR (pv - variants) * 100 >= 70 * pv), FALSE) AS collapsed, coalesce(pp >= 3 AND prices = 1, FALSE) AS flat
    FROM b LEFT JOIN l USING (page, day) QUALIFY coalesce(snap, '') = '' OR row_number() OVER (PARTITION BY offer_id, snap ORDER BY t, seq) = 1)
), f AS (
  SELECT offer_id, 0::BIGINT AS n, ''::VARCHAR AS seq, NULL::BIGINT AS price, NULL::BIGINT AS last, FALSE AS ok, ''::VARCHAR AS reasons, NULL::BIGINT AS variants, NULL::BIGINT AS prices, NULL::BIGINT AS pv, NULL::BIGINT AS pp FROM (SELECT DISTINCT offer_id FROM o)
  UNION ALL
  SELECT offer_id, n, seq, price, last, reasons = '' AS ok, reasons, variants, prices, pv, pp FROM (
    SELECT *, CASE WHEN bad IS NOT NULL THEN bad ELSE concat_ws(',', CASE WHEN band THEN 'out_of_band' END, CASE WHEN move THEN 'large_move' END, CASE WHEN claim THEN 'claimed_not_above_price' END, CASE WHEN unit THEN 'unit_mismatch' END,
      CASE WHEN changed THEN 'variant_identity_changed' END, CASE WHEN collapsed THEN 'variant_collapse' END, CASE WHEN flat THEN 'price_flattening' END, CASE WHEN odd THEN 'condition_unknown' END) END AS reasons FROM (
      SELECT o.*, {_LAST} AS last, coalesce(o.price::DOUBLE / ({_LAST}) * 100 < 35.0 OR o.price::DOUBLE / ({_LAST}) * 100 > 300.0, FALSE) AS move,
        CASE WHEN units IS NOT NULL AND lunits IS NOT NULL THEN units <> lunits WHEN lunits IS NOT NULL THEN FALSE
          WHEN units > 0 THEN coalesce(abs(o.price::DOUBLE / ({_LAST}) - 1.0::DOUBLE / units) <= 0.05::DOUBLE OR abs(o.price::DOUBLE / ({_LAST}) - units) <= 0.05::DOUBLE, FALSE)
          ELSE coalesce(list_bool_or(list_transform([3, 4, 5, 6, 10, 12, 20, 25, 50], lambda g: abs(o.price::DOUBLE / ({_LAST}) - 1.0::DOUBLE / g) <= 0.05::DOUBLE OR abs(o.price::DOUBLE / ({_LAST}) - g) <= 0.05::DOUBLE)), FALSE) END AS unit
      FROM f JOIN o ON o.offer_id = f.offer_id AND o.n = f.n + 1))
) SELECT offer_id, seq, variants, prices, pv AS previous_variants, pp AS previous_prices, last AS last_price, reasons, CASE WHEN reasons = 'invalid_price_or_currency' THEN 'REJECTED' WHEN reasons = '' THEN 'OK' ELSE 'SUSPECT' END AS verdict FROM f WHERE n > 0"""


def _shown(rows):
    return rows.select("offer_id", "seq", *sweeps.COUNTS, "last_price", F.array_join("quality_reasons", ",").alias("reasons"), F.col("quality").alias("verdict"))


@query(TICKS)
def tick_batch(spark, sf_dir):
    """Bare rows judged in one go: counts by sweep, replays dropped, the last OK price carried along."""
    rows = sweeps.with_sweep_counts(bare_events(spark, table(spark, sf_dir, "events")))
    named = F.coalesce("snapshot_ref", F.lit("")) != ""
    first = rows.where(named).groupBy("offer_id", "snapshot_ref").agg(F.min(F.struct("observed_at", "seq")).alias("first"))
    once = rows.where(named).join(first, ["offer_id", "snapshot_ref"]).where(F.struct("observed_at", "seq") == F.col("first")).drop("first")
    return _shown(guards.judged(guards.with_last_ok(once.unionByName(rows.where(~named)))))


@query(TICKS)
def tick_stream(spark, sf_dir):
    """The same from the stream: state gives the context, batches are stored, the store is read."""
    where = _checkpoint(spark)
    with _conf(spark, *STATE_STORE):
        start_ticks(bare_events(spark, _event_stream(spark, sf_dir)), f"{where}/store", f"{where}/progress", replay_hours=None).awaitTermination()
    return _shown(stored(spark, f"{where}/store"))
