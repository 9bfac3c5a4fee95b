"""The star-schema test tables seen as price history, listings and events.

Each view is given twice: as DataFrames for the queries and as SQL for the checks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import table


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as observations: a part is an offer, four parts are a variant at four retailers."""
    part, ts = F.col("l_partkey"), F.col("l_shipdate").cast("timestamp")
    return table(spark, sf_dir, "lineitem").select(
        part.alias("offer_id"),
        F.expr("l_partkey div 4").alias("variant_id"),
        (part % 4).alias("retailer_id"),
        ts.alias("observed_at"),
        F.to_date(ts).alias("observed_date"),
        F.round(F.col("l_extendedprice") / F.col("l_quantity") * 100).cast("bigint").alias("price_cents"),
        F.when(F.col("l_tax") > 0, F.round(F.col("l_tax") * 1000).cast("bigint")).alias("shipping_cents"),
        (F.col("l_discount") >= 0.08).alias("on_clearance"),
        F.when(F.col("l_returnflag") == "R", "SUSPECT").otherwise("OK").alias("quality"),
        F.when(F.col("l_linestatus") == "O", "IN_STOCK").otherwise("OUT_OF_STOCK").alias("availability"),
        F.nullif(F.col("l_quantity").cast("bigint") % 3, F.lit(0)).alias("unit_count"),
        sequence().alias("seq"),
    )


def shown_time(instant: Column) -> Column:
    """Instants leave queries as text, which reads the same in every engine."""
    return F.date_format(instant, "yyyy-MM-dd HH:mm:ss")


def sequence() -> Column:
    """A text that orders rows of one day fully: order, line, and the remaining columns."""
    parts = [F.lpad(F.col("l_orderkey").cast("string"), 12, "0"), F.lpad(F.col("l_linenumber").cast("string"), 3, "0"), F.lpad(F.col("l_suppkey").cast("string"), 9, "0")]
    cents = F.lpad(F.round(F.col("l_extendedprice") * 100).cast("bigint").cast("string"), 12, "0")
    rest = [F.lpad(F.round(F.col(c) * 100).cast("bigint").cast("string"), 6, "0") for c in ("l_quantity", "l_discount", "l_tax")]
    return F.concat(*parts, cents, *rest, "l_returnflag", "l_linestatus")


OBSERVATIONS = """
obs AS (
  SELECT l_partkey AS offer_id, l_partkey // 4 AS variant_id, l_partkey % 4 AS retailer_id,
         CAST(l_shipdate AS TIMESTAMP) AS observed_at, CAST(l_shipdate AS DATE) AS observed_date,
         CAST(round(l_extendedprice / l_quantity * 100) AS BIGINT) AS price_cents,
         CASE WHEN l_tax > 0 THEN CAST(round(l_tax * 1000) AS BIGINT) END AS shipping_cents,
         l_discount >= 0.08 AS on_clearance,
         CASE WHEN l_returnflag = 'R' THEN 'SUSPECT' ELSE 'OK' END AS quality,
         CASE WHEN l_linestatus = 'O' THEN 'IN_STOCK' ELSE 'OUT_OF_STOCK' END AS availability,
         nullif(CAST(l_quantity AS BIGINT) % 3, 0) AS unit_count,
         lpad(CAST(l_orderkey AS VARCHAR), 12, '0') || lpad(CAST(l_linenumber AS VARCHAR), 3, '0') || lpad(CAST(l_suppkey AS VARCHAR), 9, '0')
           || lpad(CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS VARCHAR), 12, '0')
           || lpad(CAST(CAST(round(l_quantity * 100) AS BIGINT) AS VARCHAR), 6, '0') || lpad(CAST(CAST(round(l_discount * 100) AS BIGINT) AS VARCHAR), 6, '0')
           || lpad(CAST(CAST(round(l_tax * 100) AS BIGINT) AS VARCHAR), 6, '0') || l_returnflag || l_linestatus AS seq
  FROM lineitem
)"""

DAILY = """
daily AS (
  SELECT offer_id, observed_date, price_cents, price_cents + shipping_cents AS landed_cents, on_clearance, availability
  FROM obs WHERE quality = 'OK'
  QUALIFY row_number() OVER (PARTITION BY offer_id, observed_date ORDER BY observed_at DESC, seq DESC) = 1
)"""


#: lineitem's pages: forty of them, looked at on the days that sell from them; a day without ends a sweep.
PAGES, GAP_SECONDS = 40, 86_400

SWEEPS = f"""sw AS (
  SELECT page_key, observed_at, sum(starts) OVER (PARTITION BY page_key ORDER BY observed_at) AS sweep FROM (
    SELECT page_key, observed_at, CASE WHEN date_diff('second', lag(observed_at) OVER (PARTITION BY page_key ORDER BY observed_at), observed_at) <= {GAP_SECONDS} THEN 0 ELSE 1 END AS starts
    FROM (SELECT DISTINCT offer_id % {PAGES} AS page_key, observed_at FROM obs))
), counts AS (
  SELECT *, lag(variants) OVER w AS previous_variants, lag(prices) OVER w AS previous_prices FROM (
    SELECT page_key, CAST(sweep AS BIGINT) AS sweep, count(DISTINCT offer_id) AS variants, count(DISTINCT price_cents) AS prices
    FROM (SELECT *, offer_id % {PAGES} AS page_key FROM obs) JOIN sw USING (page_key, observed_at) GROUP BY 1, 2)
  WINDOW w AS (PARTITION BY page_key ORDER BY sweep)
)"""


def on_pages(rows):
    """Observations with the page that shows them; the offer is what varies on a page."""
    return rows.withColumn("page_key", F.col("offer_id") % PAGES).withColumn("variant_key", F.col("offer_id").cast("string"))


def as_of(df: DataFrame, column: str) -> DataFrame:
    """One row with the newest day or instant of the data; clocks are never read."""
    return df.agg(F.max(column).alias("as_of"))


def event_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as observations with real instants: a user is an offer, the rest follows from the row."""
    ts, kind, event, user = F.col("ts").cast("timestamp"), F.col("event_type"), F.col("event_id"), F.col("user_id")
    k = F.get_json_object("props", "$.k").cast("bigint")
    used = user % 5 == 0
    return table(spark, sf_dir, "events").select(
        user.alias("offer_id"),
        F.lpad(event.cast("string"), 12, "0").alias("seq"),
        ts.alias("observed_at"),
        F.when(event % 4 == 0, F.concat(F.lit("s"), k.cast("string"))).when(event % 4 == 1, "").otherwise(event.cast("string")).alias("snapshot_ref"),
        F.when(event % 41 == 0, "REJECTED").when(kind == "error", "SUSPECT").otherwise("OK").alias("quality"),
        F.when((kind == "error") & (event % 2 == 0), "out_of_band").alias("other_reason"),
        F.when(event % 5 == 0, "DISCOVERY_GRID").otherwise("PRODUCT_PAGE").alias("detected_via"),
        F.when(event % 7 == 0, "CLEARANCE_LISTING").otherwise("PRODUCT").alias("page_type"),
        F.when(event % 29 == 0, "b").otherwise("a").alias("identity"),
        F.when(used, "USED_GOOD").otherwise("NEW").alias("condition"),
        F.when(used, "USED").otherwise("NEW").alias("condition_group"),
        F.when((kind == "purchase") & (event % 3 == 0), "OUT_OF_STOCK").when(event % 6 == 0, "STORE_ONLY").otherwise("IN_STOCK").alias("availability"),
        (event % 3 != 0).alias("on_clearance"),
        F.when(event % 53 != 0, F.round(F.col("value") * 100).cast("bigint")).alias("price_cents"),
        F.when(k % 2 == 0, k).alias("shipping_cents"),
        (k * 100).alias("claimed_cents"),
        F.when((user % 3 != 0) & (event % 47 != 0), F.lit(6000).cast("bigint")).alias("verified_cents"),
        F.lit(5000).cast("bigint").alias("current_new_cents"),
        F.when(user % 31 == 0, "z").alias("reference_key"),
        F.when(user % 37 == 0, F.lit(5).cast("bigint")).alias("reference_units"),
        F.when(event % 19 == 0, "other").otherwise("k").alias("variant_key"),
        F.when(event % 23 == 0, F.lit(2).cast("bigint")).when(user % 37 == 0, F.lit(3).cast("bigint")).alias("unit_count"),
        F.lit("k").alias("listing_key"),
        F.when(user % 37 == 0, F.lit(3).cast("bigint")).alias("listing_units"),
        F.lit(400).cast("bigint").alias("floor_cents"),
    )
