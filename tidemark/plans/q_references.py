"""Daily prices and references over the price history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.money import discount_bp
from ..operators import references as R
from ..operators.latest import latest_by
from .registering import query
from .star import DAILY, OBSERVATIONS, as_of, observations, shown_time

#: The test history is sparse, so the evidence bar is lower than the default.
WINDOW_DAYS, MIN_DAYS, MIN_SPAN = 10000, 10, 30

STATS = """
stats AS (
  SELECT offer_id, percentile_cont(0.5) WITHIN GROUP (ORDER BY price_cents) FILTER (WHERE NOT on_clearance) AS median_cents,
         count(*) FILTER (WHERE NOT on_clearance) AS days,
         date_diff('day', min(observed_date) FILTER (WHERE NOT on_clearance), max(observed_date) FILTER (WHERE NOT on_clearance)) AS span_days,
         min(price_cents) FILTER (WHERE NOT on_clearance) AS low_cents, min(observed_date) AS first_day
  FROM daily WHERE observed_date >= (SELECT max(observed_date) FROM obs) - INTERVAL 10000 DAY GROUP BY offer_id
)"""
OWN = """
own AS (
  SELECT * FROM (
    SELECT offer_id, CAST(round_even(percentile_cont(0.5) WITHIN GROUP (ORDER BY price_cents), 0) AS BIGINT) AS reference_cents,
           count(*) AS days, date_diff('day', min(observed_date), max(observed_date)) AS span_days
    FROM (
      SELECT * FROM obs WHERE quality = 'OK' AND NOT on_clearance AND observed_date >= (SELECT max(observed_date) FROM obs) - INTERVAL 10000 DAY
      QUALIFY row_number() OVER (PARTITION BY offer_id, observed_date ORDER BY observed_at DESC, seq DESC) = 1
    ) GROUP BY offer_id
  ) WHERE days >= 10 AND span_days >= 30
)"""
STATE = """
state AS (
  SELECT * FROM obs WHERE quality = 'OK' AND availability = 'IN_STOCK' AND observed_at >= (SELECT max(observed_at) FROM obs) - INTERVAL 10000 DAY
  QUALIFY row_number() OVER (PARTITION BY offer_id ORDER BY observed_at DESC, seq DESC) = 1
)"""
CROSS = """
crossed AS (
  SELECT offer_id, reference_cents, retailer_id FROM (
    SELECT a.offer_id, b.price_cents AS reference_cents, b.retailer_id,
           row_number() OVER (PARTITION BY a.offer_id ORDER BY b.price_cents, b.retailer_id, b.offer_id) AS rn
    FROM state a JOIN state b ON a.variant_id = b.variant_id AND a.unit_count = b.unit_count AND a.offer_id <> b.offer_id
  ) WHERE rn = 1
)"""
ALL = f"WITH {OBSERVATIONS}, {DAILY}, {STATS}, {OWN}, {STATE}, {CROSS}"


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.offer_daily_price(observations(spark, sf_dir))


def own(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = observations(spark, sf_dir)
    day = as_of(obs, "observed_date").select(F.date_sub("as_of", WINDOW_DAYS).alias("start"))
    rows = obs.join(F.broadcast(day), F.col("observed_date") >= F.col("start")).drop("start")
    return R.own_history_median(rows, F.lit("1900-01-01").cast("date"), 0, MIN_DAYS, MIN_SPAN)


def state(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = observations(spark, sf_dir)
    newest = as_of(obs, "observed_at")
    rows = obs.join(F.broadcast(newest))
    return R.latest_offer_state(rows, F.col("as_of"), f"{WINDOW_DAYS} DAYS").drop("as_of")


@query(f"{ALL} SELECT * FROM daily")
def offer_daily_price(spark, sf_dir):
    return daily(spark, sf_dir)


@query(f"{ALL} SELECT * FROM stats")
def offer_reference_stats(spark, sf_dir):
    d = daily(spark, sf_dir)
    newest = as_of(observations(spark, sf_dir), "observed_date")
    return R.offer_reference_stats(d.join(F.broadcast(newest)), F.col("as_of"), WINDOW_DAYS)


@query(f"{ALL} SELECT * FROM own")
def own_history_median(spark, sf_dir):
    return own(spark, sf_dir)


@query(f"{ALL} SELECT * FROM crossed")
def cross_retailer_reference(spark, sf_dir):
    s = state(spark, sf_dir)
    return R.cross_retailer_reference(s, s)


@query(
    f"""{ALL} SELECT s.offer_id, min(coalesce(b.price_cents + b.shipping_cents, b.price_cents)) AS reference_cents
    FROM state s JOIN state b ON s.variant_id = b.variant_id GROUP BY s.offer_id"""
)
def current_new_reference(spark, sf_dir):
    s = state(spark, sf_dir)
    return R.current_new_reference(s, s)


@query(
    f"""{ALL} SELECT coalesce(o.offer_id, c.offer_id) AS offer_id, least(o.reference_cents, c.reference_cents) AS reference_cents,
    CASE WHEN o.reference_cents IS NOT NULL AND (c.reference_cents IS NULL OR o.reference_cents <= c.reference_cents)
         THEN 'OWN_HISTORY_MEDIAN_90D' ELSE 'CROSS_RETAILER_NEW' END AS reference_kind
    FROM own o FULL JOIN crossed c ON o.offer_id = c.offer_id"""
)
def verified_reference(spark, sf_dir):
    s = state(spark, sf_dir)
    return R.verified_reference(own(spark, sf_dir), R.cross_retailer_reference(s, s))


@query(
    f"""{ALL} SELECT o.offer_id, CAST(round(p.p_retailprice * 100) AS BIGINT) AS claimed_cents, o.reference_cents,
    CAST(round(p.p_retailprice * 100) AS BIGINT) > o.reference_cents * 1.25 AS inflated
    FROM own o JOIN part p ON p.p_partkey = o.offer_id"""
)
def claimed_inflation(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("offer_id"), F.round(F.col("p_retailprice") * 100).cast("bigint").alias("claimed_cents"))
    both = own(spark, sf_dir).join(part, "offer_id")
    return both.select("offer_id", "claimed_cents", "reference_cents", R.claimed_inflated(F.col("claimed_cents"), F.col("reference_cents")).alias("inflated"))


@query(
    f"""{ALL} SELECT s.variant_id, s.retailer_id, s.offer_id, s.price_cents, t.median_cents FROM (
      SELECT * FROM obs WHERE quality = 'OK' AND availability = 'IN_STOCK'
      QUALIFY row_number() OVER (PARTITION BY variant_id, retailer_id ORDER BY observed_at DESC, seq DESC) = 1
    ) s LEFT JOIN stats t ON s.offer_id = t.offer_id"""
)
def variant_current_new(spark, sf_dir):
    obs = observations(spark, sf_dir)
    rows = latest_by(obs.where("quality = 'OK' and availability = 'IN_STOCK'"), ["variant_id", "retailer_id"], R.newest())
    stats = offer_reference_stats(spark, sf_dir).select("offer_id", "median_cents")
    return rows.join(stats, "offer_id", "left").select("variant_id", "retailer_id", "offer_id", "price_cents", "median_cents")


@query(
    f"""{ALL} SELECT d.offer_id, d.observed_date, d.price_cents, o.reference_cents,
    CAST(round((o.reference_cents - d.price_cents) * 10000.0::DOUBLE / o.reference_cents) AS BIGINT) AS discount_bp
    FROM daily d JOIN own o ON d.offer_id = o.offer_id
    WHERE CAST(round((o.reference_cents - d.price_cents) * 10000.0::DOUBLE / o.reference_cents) AS BIGINT) >= 5000"""
)
def deep_discounts(spark, sf_dir):
    """Days on which an offer was at half its own median or less."""
    both = daily(spark, sf_dir).select("offer_id", "observed_date", "price_cents").join(own(spark, sf_dir).select("offer_id", "reference_cents"), "offer_id")
    return both.withColumn("discount_bp", discount_bp(F.col("price_cents"), F.col("reference_cents"))).where("discount_bp >= 5000")


@query(
    f"""WITH {OBSERVATIONS} SELECT offer_id, strftime(observed_at, '%Y-%m-%d %H:%M:%S') AS observed_at, seq, price_cents,
    last_value(CASE WHEN quality = 'OK' THEN price_cents END IGNORE NULLS) OVER (PARTITION BY offer_id ORDER BY observed_at, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_price
    FROM obs"""
)
def last_ok_price(spark, sf_dir):
    return R.last_ok_before(observations(spark, sf_dir)).select("offer_id", shown_time(F.col("observed_at")).alias("observed_at"), "seq", "price_cents", "last_price")
