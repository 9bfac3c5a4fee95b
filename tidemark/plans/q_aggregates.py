"""Aggregates: histories, health, counts, spreads."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.files import table
from .q_references import ALL, daily
from .registering import query
from .star import observations, shown_time


@query(
    f"""{ALL} SELECT CAST(offer_id // 4 AS BIGINT) AS variant_id, offer_id % 4 AS retailer_id, CASE WHEN on_clearance THEN 'CLEARANCE' ELSE 'REGULAR' END AS lane, observed_date,
    min(price_cents) AS price_cents FROM daily GROUP BY ALL"""
)
def variant_history_daily_min(spark, sf_dir):
    d = daily(spark, sf_dir)
    keys = [F.expr("offer_id div 4").alias("variant_id"), (F.col("offer_id") % 4).alias("retailer_id"), F.when(F.col("on_clearance"), "CLEARANCE").otherwise("REGULAR").alias("lane"), F.col("observed_date")]
    return d.groupBy(*keys).agg(F.min("price_cents").alias("price_cents"))


@query(
    """SELECT count(*) FILTER (WHERE o_orderstatus = 'F') AS verified, count(*) FILTER (WHERE o_orderstatus = 'O') AS claimed, count(*) FILTER (WHERE o_orderstatus = 'P') AS used,
    count(*) AS total FROM orders"""
)
def counts_by_lane(spark, sf_dir):
    lane = F.col("o_orderstatus")
    return table(spark, sf_dir, "orders").agg(F.count_if(lane == "F").alias("verified"), F.count_if(lane == "O").alias("claimed"), F.count_if(lane == "P").alias("used"), F.count("*").alias("total"))


@query(
    """SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour, user_id % 5 AS retailer_id, count(*) AS fetched, count(*) FILTER (WHERE event_type = 'error') AS blocked,
    count(*) FILTER (WHERE event_type = 'purchase') AS ok FROM events GROUP BY 1, 2"""
)
def hourly_health_rollup(spark, sf_dir):
    kind = F.col("event_type")
    rows = table(spark, sf_dir, "events").groupBy(F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("hour"), (F.col("user_id") % 5).alias("retailer_id"))
    made = rows.agg(F.count("*").alias("fetched"), F.count_if(kind == "error").alias("blocked"), F.count_if(kind == "purchase").alias("ok"))
    return made.withColumn("hour", shown_time(F.col("hour")))


@query(
    f"""{ALL} SELECT variant_id, max(price_cents) AS high_cents,
    coalesce(min(price_cents) FILTER (WHERE availability = 'IN_STOCK'), min(price_cents)) AS low_cents, count(*) AS points
    FROM obs GROUP BY variant_id HAVING count(*) >= 2"""
)
def variant_discount_vs_high(spark, sf_dir):
    price = F.col("price_cents")
    low = F.coalesce(F.min(F.when(F.col("availability") == "IN_STOCK", price)), F.min(price))
    made = observations(spark, sf_dir).groupBy("variant_id").agg(F.max(price).alias("high_cents"), low.alias("low_cents"), F.count("*").alias("points"))
    return made.where("points >= 2")


@query(
    f"""{ALL} SELECT offer_id, observed_date,
    CAST(CASE WHEN hi = lo THEN 500 ELSE round((price_cents - lo) * 1000.0::DOUBLE / (hi - lo)) END AS BIGINT) AS height FROM (
      SELECT offer_id, observed_date, price_cents, min(price_cents) OVER w AS lo, max(price_cents) OVER w AS hi FROM daily WINDOW w AS (PARTITION BY offer_id))"""
)
def sparkline_minmax(spark, sf_dir):
    d = daily(spark, sf_dir).select("offer_id", "observed_date", "price_cents")
    d = d.join(d.groupBy("offer_id").agg(F.min("price_cents").alias("lo"), F.max("price_cents").alias("hi")), "offer_id")
    scaled = F.round((F.col("price_cents") - F.col("lo")) * F.lit(1000.0) / (F.col("hi") - F.col("lo")))
    return d.select("offer_id", "observed_date", F.when(F.col("hi") == F.col("lo"), F.lit(500).cast("bigint")).otherwise(F.when(F.col("hi") > F.col("lo"), scaled).cast("bigint")).alias("height"))


@query("SELECT n_regionkey AS retailer_id, count(*) AS urls, 3000 - count(*) AS free FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 0 GROUP BY 1")
def enabled_url_room(spark, sf_dir):
    nation = F.broadcast(table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey"))
    rows = table(spark, sf_dir, "customer").where("c_acctbal > 0").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy(F.col("n_regionkey").alias("retailer_id")).agg(F.count("*").alias("urls")).withColumn("free", F.lit(3000).cast("bigint") - F.col("urls"))


@query("SELECT user_id AS variant_id, list_aggregate(list_sort(list_distinct(list(CAST(json_extract(props, '$.k') AS BIGINT)))), 'string_agg', ',') AS merged FROM events GROUP BY 1")
def gtin_union(spark, sf_dir):
    """Distinct union of what several rows list, in order."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    made = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("variant_id")).agg(F.array_sort(F.collect_set(k)).alias("ks"))
    return made.select("variant_id", F.array_join("ks", ",").alias("merged"))
