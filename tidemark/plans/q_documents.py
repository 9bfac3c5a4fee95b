"""Export documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.money import discount_bp
from ..operators import documents as D
from ..operators import schemas
from ..sources.files import dealt, table
from .q_references import ALL, daily
from .registering import query
from .star import OBSERVATIONS, observations

FACTS = """facts AS (SELECT user_id % 20 AS retailer_id, max(ts) FILTER (WHERE event_type = 'purchase') AS last_success, count(*) FILTER (WHERE event_type = 'error') AS blocked, count(*) AS fetched,
  CASE WHEN user_id % 20 = 3 THEN TIMESTAMP '2030-01-01' END AS breaker, (SELECT max(ts) FROM events) AS now FROM events GROUP BY user_id % 20)"""


def health(spark, sf_dir):
    events = table(spark, sf_dir, "events").select((F.col("user_id") % 20).alias("retailer_id"), F.col("ts").cast("timestamp").alias("ts"), "event_type")
    kind = F.col("event_type")
    facts = events.groupBy("retailer_id").agg(F.max(F.when(kind == "purchase", F.col("ts"))).alias("last_success"), F.count_if(kind == "error").alias("blocked"), F.count("*").alias("fetched"))
    facts = facts.withColumn("breaker_open_until", F.when(F.col("retailer_id") == 3, F.lit("2030-01-01").cast("timestamp")))
    now = F.broadcast(events.agg(F.max("ts").alias("now")))
    return D.retailer_health(facts.join(now), F.col("now"))


HEALTH = f"""WITH {FACTS}, h AS (SELECT retailer_id, coalesce(breaker > now, FALSE) AS open, last_success IS NULL OR last_success < now - INTERVAL 12 HOUR AS old, blocked::DOUBLE / fetched AS block_rate FROM facts)"""


@query(f"{HEALTH} SELECT retailer_id, CASE WHEN open THEN 'FAILED' WHEN old OR block_rate > 0.20 THEN 'DEGRADED' ELSE 'HEALTHY' END AS status, open OR old AS stale, block_rate FROM h")
def retailer_health(spark, sf_dir):
    return health(spark, sf_dir)


@query(f"{HEALTH} SELECT bool_and(open OR old) AS all_stale, count(*) AS retailers FROM h")
def all_stale_gate(spark, sf_dir):
    return health(spark, sf_dir).agg(F.every("stale").alias("all_stale"), F.count("*").alias("retailers"))


DEALS = """deals AS (
  SELECT o_orderkey AS deal_id, CASE o_orderstatus WHEN 'F' THEN 'VERIFIED' WHEN 'O' THEN 'CLAIMED' ELSE 'USED' END AS lane,
    CASE o_orderkey % 3 WHEN 0 THEN 'FIRST_PARTY' WHEN 1 THEN 'RETAILER_RESALE' ELSE 'MARKETPLACE_3P' END AS seller, CASE o_orderkey % 4 WHEN 0 THEN 'IN_STOCK' WHEN 1 THEN 'BACKORDER' WHEN 2 THEN 'STORE_ONLY' END AS stock,
    CAST(round(o_totalprice * 100) AS BIGINT) AS price_cents, CAST(round(o_totalprice * 100) AS BIGINT) * 3 AS reference,
    CASE o_orderstatus WHEN 'F' THEN CASE WHEN o_orderkey % 2 = 0 THEN 'OWN_HISTORY_MEDIAN_90D' ELSE 'CROSS_RETAILER_NEW' END WHEN 'O' THEN 'RETAILER_CLAIMED' ELSE 'CURRENT_NEW' END AS kind,
    CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderkey % 90 END AS days, CASE WHEN o_orderkey % 6 > 0 THEN CAST(round(o_totalprice * 100) AS BIGINT) * 4 END AS claimed_cents, o_orderdate AS detected FROM orders
)"""


def deals(spark, sf_dir):
    k, status = F.col("o_orderkey"), F.col("o_orderstatus")
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    return table(spark, sf_dir, "orders").select(
        k.alias("deal_id"),
        F.when(status == "F", "VERIFIED").when(status == "O", "CLAIMED").otherwise("USED").alias("lane"),
        F.when(k % 3 == 0, "FIRST_PARTY").when(k % 3 == 1, "RETAILER_RESALE").otherwise("MARKETPLACE_3P").alias("seller_type"),
        F.when(k % 4 == 0, "IN_STOCK").when(k % 4 == 1, "BACKORDER").when(k % 4 == 2, "STORE_ONLY").alias("availability"),
        cents.alias("price_cents"),
        (cents * 3).alias("reference_cents"),
        F.when(status == "F", F.when(k % 2 == 0, "OWN_HISTORY_MEDIAN_90D").otherwise("CROSS_RETAILER_NEW")).when(status == "O", "RETAILER_CLAIMED").otherwise("CURRENT_NEW").alias("reference_kind"),
        F.when(k % 5 != 0, k % 90).alias("reference_days"),
        F.when(k % 6 > 0, cents * 4).alias("claimed_cents"),
        F.when(k % 6 == 1, "COMPARE_AT").when(k % 6 == 2, "WAS").otherwise("ODD").alias("claimed_kind"),
        discount_bp(cents, cents * 3).alias("discount_bp"),
        F.col("o_orderdate").cast("timestamp").alias("detected_at"),
        F.lit(None).cast("timestamp").alias("last_confirmed_at"),
    )


DOCUMENT = f"""WITH {DEALS}, docs AS (SELECT deal_id, lane, CASE seller WHEN 'MARKETPLACE_3P' THEN 'MARKETPLACE' ELSE 'FIRST_PARTY' END AS seller_type,
  CASE stock WHEN 'BACKORDER' THEN 'OUT_OF_STOCK' ELSE coalesce(stock, 'OUT_OF_STOCK') END AS availability, price_cents, CASE WHEN kind <> 'RETAILER_CLAIMED' THEN reference END AS reference_cents,
  CASE kind WHEN 'RETAILER_CLAIMED' THEN NULL WHEN 'CURRENT_NEW' THEN 'CROSS_RETAILER_NEW' ELSE kind END AS reference_kind,
  CASE kind WHEN 'RETAILER_CLAIMED' THEN NULL WHEN 'OWN_HISTORY_MEDIAN_90D' THEN coalesce('Median of its own prices over ' || days || ' days', 'Median of its own prices')
    WHEN 'CURRENT_NEW' THEN 'Lowest current new price' ELSE 'Lowest price at another shop' END AS reference_label,
  claimed_cents, CASE WHEN claimed_cents IS NULL THEN NULL WHEN deal_id % 6 = 2 THEN 'WAS' ELSE 'LIST' END AS claimed_kind,
  CAST(round((reference - price_cents) * 10000.0::DOUBLE / reference) AS BIGINT) AS discount_bp, strftime(detected, '%Y-%m-%dT%H:%M:%SZ') AS detected_at, strftime(detected, '%Y-%m-%dT%H:%M:%SZ') AS last_confirmed_at FROM deals)"""


@query(f"{DOCUMENT} SELECT * FROM docs")
def deal_document(spark, sf_dir):
    return D.deal_documents(deals(spark, sf_dir))


def altered(spark, sf_dir):
    """Documents of which some break a rule: a lane that does not exist, a reference that is missing or should not be there."""
    k, lane = F.col("deal_id"), F.col("lane")
    reference = F.when((k % 89 == 0) & (lane != "CLAIMED"), F.lit(None)).when((k % 83 == 0) & (lane == "CLAIMED"), F.col("price_cents") * 2).when(k % 79 == 0, F.col("price_cents")).otherwise(F.col("reference_cents"))
    changed = D.deal_documents(deals(spark, sf_dir)).withColumn("reference_cents", reference.cast("bigint")).withColumn("lane", F.when(k % 97 == 0, F.concat(F.lit("X"), "lane")).otherwise(lane))
    url = F.when(k % 73 == 0, "http://shop.example.com/").when(k % 71 == 0, "https://other.example.com/").otherwise("https://shop.example.com/")
    return changed.withColumns({"retailer_url": url, "hosts": F.array(F.lit("shop.example.com"), F.lit("www.shop.example.com"))})


ALTERED = f"""{DOCUMENT}, altered AS (
  SELECT * REPLACE (CASE WHEN deal_id % 97 = 0 THEN 'X' || lane ELSE lane END AS lane,
    CASE WHEN deal_id % 89 = 0 AND lane <> 'CLAIMED' THEN NULL WHEN deal_id % 83 = 0 AND lane = 'CLAIMED' THEN price_cents * 2 WHEN deal_id % 79 = 0 THEN price_cents ELSE reference_cents END AS reference_cents) FROM docs
)"""


@query(
    f"""{ALTERED} SELECT deal_id, 'lane_enum' AS rule FROM altered WHERE lane NOT IN ('VERIFIED', 'CLAIMED', 'USED')
    UNION ALL SELECT deal_id, 'price_positive' FROM altered WHERE NOT price_cents > 0
    UNION ALL SELECT deal_id, 'verified_with_reference' FROM altered WHERE lane IN ('VERIFIED', 'USED') AND reference_cents IS NULL
    UNION ALL SELECT deal_id, 'claimed_without_reference' FROM altered WHERE lane = 'CLAIMED' AND reference_cents IS NOT NULL
    UNION ALL SELECT deal_id, 'reference_above_price' FROM altered WHERE reference_cents <= price_cents
    UNION ALL SELECT deal_id, 'url_allowed' FROM altered WHERE deal_id % 73 = 0 OR deal_id % 71 = 0"""
)
def feed_validation(spark, sf_dir):
    return D.feed_violations(altered(spark, sf_dir))


def deal_texts(spark, sf_dir):
    """Deals as JSON texts in full, every thirteenth of a kind broken in a way of its own."""
    k, cents = F.col("deal_id"), F.col("price_cents")
    way = k % 13
    text = lambda c: F.lit(c)
    detail = F.struct(F.lit("OWN_HISTORY_MEDIAN_90D").alias("kind"), F.when(way == 6, F.lit(0).cast("bigint")).otherwise(cents * 3).alias("cents"), F.lit("L").alias("label"), F.when(way == 5, 1).alias("surplus"))
    claim = F.struct(F.when(way == 7, "ODD").otherwise("WAS").alias("kind"), (cents * 4).alias("cents"), F.lit(False).alias("inflated_vs_reference"))
    row = F.struct(
        k.cast("string").alias("deal_id"), F.when(way == 0, "CLEAR").otherwise(F.col("lane")).alias("lane"), text("DEEP_DISCOUNT_NEW").alias("rule"), text("p").alias("product_slug"), text("P").alias("product_name"),
        F.when(way == 1, "").otherwise("B").alias("brand"), text("rod").alias("category"), text("v").alias("variant_pub_id"), text("V").alias("variant_label"), text("s").alias("retailer_slug"), text("https://s.example.com/").alias("retailer_url"),
        text("NEW").alias("condition"), text("S").alias("seller_name"), F.col("seller_type"), F.when(way == 2, F.lit(0).cast("bigint")).otherwise(cents).alias("price_cents"), F.lit(None).cast("bigint").alias("shipping_cents"), F.lit(None).cast("bigint").alias("landed_price_cents"),
        F.when(k % 2 == 0, detail).alias("reference"), F.when(k % 3 == 0, claim).alias("claimed_reference"), F.when(way == 3, F.lit(100.5)).otherwise(F.lit(66.67)).alias("discount_pct"), F.col("availability"),
        F.lit(5).alias("stock_qty"), F.col("detected_at").alias("first_confirmed_at"), F.col("last_confirmed_at"),
    )
    # Each text is a column before it is altered, so that no alteration writes it anew.
    written = D.deal_documents(dealt(deals(spark, sf_dir))).select("deal_id", F.to_json(row, {"ignoreNullFields": "false"}).alias("body"))
    whole = F.col("body")
    # A surplus key that is null is no key in the texts of sound deals.
    sound = F.when(way == 5, whole).otherwise(F.replace(whole, F.lit(',"surplus":null'), F.lit("")))
    altered = F.when(way == 4, F.replace(whole, F.lit('"stock_qty":5,'), F.lit(""))).when(way == 8, F.regexp_replace(whole, r'"price_cents":\d+', '"price_cents":"1"')).when(way == 9, F.replace(whole, F.lit("}"), F.lit(""))).when(way == 10, F.replace(whole, F.lit('"stock_qty":5'), F.lit('"stock_qty":5.5'))).otherwise(whole)
    return written.withColumn("body", sound).withColumn("body", altered)


@query(
    f"""{DOCUMENT} SELECT deal_id, path, rule FROM docs JOIN (VALUES (0, 'lane', 'enum', 1, 1), (1, 'brand', 'empty', 1, 1), (2, 'price_cents', 'bounds', 1, 1), (3, 'discount_pct', 'bounds', 1, 1), (4, 'stock_qty', 'required', 1, 1),
      (5, 'reference', 'extra_keys', 2, 1), (6, 'reference.cents', 'bounds', 2, 1), (7, 'claimed_reference.kind', 'enum', 1, 3), (8, 'price_cents', 'type', 1, 1), (9, '', 'json', 1, 1), (10, 'stock_qty', 'type', 1, 1)) AS w(way, path, rule, half, third)
    ON deal_id % 13 = way AND deal_id % half = 0 AND deal_id % third = 0"""
)
def feed_schema_violations(spark, sf_dir):
    return schemas.schema_violations(deal_texts(spark, sf_dir), "body", schemas.DEAL, "deal_id")


def product_texts(spark, sf_dir):
    """Products as nested JSON texts; offers of every seventh part have a negative price, of every ninth no word on clearance."""
    o = F.col("offer_id")
    offer = F.struct(
        F.lit("s").alias("retailer_slug"), F.lit("u").alias("url"), F.lit("NEW").alias("condition"), F.lit("S").alias("seller_name"), F.lit("MARKETPLACE").alias("seller_type"), F.when(o % 7 == 0, -F.col("low")).otherwise(F.col("low")).alias("price_cents"),
        F.lit(0).alias("shipping_cents"), F.lit("IN_STOCK").alias("availability"), F.when(o % 9 != 0, F.lit(True)).alias("on_clearance"), F.lit("t").alias("observed_at"),
    )
    lows = observations(spark, sf_dir).groupBy("offer_id", "variant_id").agg(F.min("price_cents").alias("low"))
    listed = lambda c: F.transform(F.array_sort(F.collect_list(c)), lambda x: x["o"])
    variants = lows.groupBy("variant_id").agg(listed(F.struct(o.alias("k"), offer.alias("o"))).alias("offers"))
    variant = F.struct(F.col("variant_id").cast("string").alias("variant_pub_id"), F.lit("L").alias("label"), F.struct(F.lit(1).alias("a")).alias("attributes"), "offers", F.array().cast("array<int>").alias("history"))
    products = variants.groupBy(F.expr("variant_id div 5").alias("product_id")).agg(listed(F.struct(F.col("variant_id").alias("k"), variant.alias("o"))).alias("variants"))
    row = F.struct(F.lit("p").alias("slug"), F.lit("P").alias("name"), F.lit("B").alias("brand"), F.when(F.col("product_id") % 11 == 0, "boat").otherwise("rod").alias("category"), "variants")
    return products.select("product_id", F.to_json(row).alias("body"))


@query(
    f"""WITH {OBSERVATIONS}, o AS (SELECT DISTINCT offer_id, variant_id, variant_id // 5 AS product_id FROM obs),
    p AS (SELECT *, 'variants.' || (dense_rank() OVER (PARTITION BY product_id ORDER BY variant_id) - 1) || '.offers.' || (row_number() OVER (PARTITION BY variant_id ORDER BY offer_id) - 1) AS at FROM o)
    SELECT product_id, 'category' AS path, 'enum' AS rule FROM (SELECT DISTINCT product_id FROM o) WHERE product_id % 11 = 0
    UNION ALL SELECT product_id, "at" || '.price_cents', 'bounds' FROM p WHERE offer_id % 7 = 0 UNION ALL SELECT product_id, "at" || '.on_clearance', 'required' FROM p WHERE offer_id % 9 = 0"""
)
def product_schema_violations(spark, sf_dir):
    return schemas.schema_violations(product_texts(spark, sf_dir), "body", schemas.PRODUCT, "product_id")


@query(
    f"""{ALL}, o AS (SELECT variant_id, count(DISTINCT offer_id) AS offers, min(price_cents) AS low FROM obs WHERE quality = 'OK' GROUP BY 1),
    h AS (SELECT offer_id // 4 AS variant_id, count(*) AS points FROM daily GROUP BY 1)
    SELECT CAST(v.variant_id // 5 AS BIGINT) AS product_id, count(*) AS variants, CAST(coalesce(sum(o.offers), 0) AS BIGINT) AS offers, CAST(coalesce(sum(h.points), 0) AS BIGINT) AS history, min(o.low) AS low_cents
    FROM (SELECT DISTINCT variant_id FROM obs) v LEFT JOIN o USING (variant_id) LEFT JOIN h USING (variant_id) GROUP BY 1"""
)
def product_document(spark, sf_dir):
    """Nested product documents, counted back from their JSON text."""
    obs = observations(spark, sf_dir)
    offers = obs.where("quality = 'OK'").groupBy("variant_id", "offer_id", "retailer_id").agg(F.min("price_cents").alias("price_cents"), F.max("availability").alias("availability"))
    history = daily(spark, sf_dir).select(F.expr("offer_id div 4").alias("variant_id"), (F.col("offer_id") % 4).alias("retailer_id"), "observed_date", "price_cents")
    products = obs.select("variant_id").distinct().withColumn("product_id", F.expr("variant_id div 5"))
    made = D.product_documents(products, offers, history)
    back = made.select("product_id", F.from_json(F.to_json(F.struct("variants")), "variants array<struct<variant_id:bigint,offers:array<struct<price_cents:bigint>>,history:array<struct<price_cents:bigint>>>>").alias("d"))
    total = lambda part: F.aggregate("d.variants", F.lit(0).cast("bigint"), lambda n, v: n + F.size(v[part]))
    low = F.array_min(F.transform("d.variants", lambda v: F.array_min(F.transform(v["offers"], lambda o: o["price_cents"]))))
    return back.select("product_id", F.size("d.variants").cast("bigint").alias("variants"), total("offers").alias("offers"), total("history").alias("history"), low.alias("low_cents"))
