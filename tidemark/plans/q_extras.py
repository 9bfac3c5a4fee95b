"""Further shapes of the inventory: seeds, fallbacks, promotion, heads of documents, display texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import display
from ..operators import documents as D
from ..operators import catalog, work
from ..sources import landed
from ..sources.files import snapshot_ref as make_ref
from ..sources.files import table
from ..sources.markup import next_page, used_wording
from .q_documents import DOCUMENT, FACTS, deals, health
from .q_work import TASKS, tasks
from .q_stateful import _checkpoint
from .registering import query
from .star import shown_time


@query(
    """WITH s AS (SELECT c_nationkey AS retailer, c_custkey AS page FROM customer WHERE c_nationkey < 12), f AS (SELECT s_nationkey AS retailer, s_suppkey AS page FROM supplier)
    SELECT * FROM s UNION ALL SELECT * FROM f WHERE retailer NOT IN (SELECT retailer FROM s)"""
)
def discovery_fallback(spark, sf_dir):
    stored = table(spark, sf_dir, "customer").where("c_nationkey < 12").select(F.col("c_nationkey").alias("retailer"), F.col("c_custkey").alias("page"))
    configured = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("retailer"), F.col("s_suppkey").alias("page"))
    return work.with_fallback(stored, configured)


@query(
    """SELECT n.n_nationkey AS retailer_id, p.p_partkey AS page FROM part p JOIN nation n ON n.n_nationkey = p.p_partkey % 40
    WHERE NOT EXISTS (SELECT 1 FROM supplier s WHERE s.s_suppkey = p.p_partkey)"""
)
def seed_pages(spark, sf_dir):
    values = table(spark, sf_dir, "part").select((F.col("p_partkey") % 40).alias("retailer"), F.col("p_partkey").alias("page"))
    parents = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("retailer"), F.col("n_nationkey").alias("retailer_id"))
    stored = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("page"))
    return work.seeded(values, parents, stored, ["page"]).select("retailer_id", "page")


@query(
    f"""WITH {TASKS}, hot AS (SELECT DISTINCT p_partkey AS v FROM part WHERE p_size = 7)
    SELECT task_id, CASE WHEN v IS NOT NULL THEN least(CAST(substr(priority, 1, 1) AS INT), 2) ELSE CAST(substr(priority, 1, 1) AS INT) END AS priority,
    strftime(CASE WHEN v IS NOT NULL THEN least(not_before, TIMESTAMP '1998-01-01') ELSE not_before END, '%Y-%m-%d %H:%M:%S') AS not_before FROM tasks LEFT JOIN hot ON v = task_id % 2000"""
)
def promote_hot(spark, sf_dir):
    rows = tasks(spark, sf_dir).withColumn("priority", F.substring("priority", 1, 1).cast("int")).withColumn("variant_id", F.col("task_id") % 2000)
    hot = table(spark, sf_dir, "part").where("p_size = 7").select(F.col("p_partkey").alias("variant_id"))
    done = work.promoted(rows, hot, F.lit("1998-01-01").cast("timestamp"), 2)
    return done.select("task_id", "priority", shown_time(F.col("not_before")).alias("not_before"))


@query(
    f"""{DOCUMENT}, {FACTS}, h AS (SELECT coalesce(breaker > now, FALSE) OR last_success IS NULL OR last_success < now - INTERVAL 12 HOUR OR blocked::DOUBLE / fetched > 0.20 AS bad FROM facts)
    SELECT 2 AS schema_version, '2024-06-01T00:00:00Z' AS generated_at, count(*) FILTER (WHERE lane = 'VERIFIED') AS verified, count(*) FILTER (WHERE lane = 'CLAIMED') AS claimed,
    count(*) FILTER (WHERE lane = 'USED') AS used, count(*) AS deals, (SELECT count(*) FROM h) AS retailers, (SELECT count(*) FROM h WHERE bad) AS unhealthy FROM docs"""
)
def export_meta(spark, sf_dir):
    return D.meta_document(D.deal_documents(deals(spark, sf_dir)), health(spark, sf_dir), F.lit("2024-06-01").cast("timestamp"))


@query(
    """SELECT p_partkey AS deal_id, p_retailprice FROM part WHERE p_brand = 'Brand#11' AND p_size % 2 = 0 ORDER BY p_retailprice, p_partkey LIMIT 50"""
)
def client_view(spark, sf_dir):
    """A client's view: one category, used goods, cheapest first, its first page."""
    docs = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("deal_id"), "p_retailprice", F.col("p_brand").alias("category"), F.when(F.col("p_size") % 2 == 0, "USED_GOOD").otherwise("NEW").alias("condition"),
        F.lit(None).cast("double").alias("landed_cents"), F.col("p_retailprice").alias("price_cents"),
    )
    view = D.feed_filter(docs, category="Brand#11", condition="used")
    return view.orderBy(*D.feed_sort(view, "price_asc")).limit(50).select("deal_id", "p_retailprice")


@query(
    """WITH t AS (SELECT o_orderkey, o_custkey % 10001 AS bp, CAST(round((o_custkey % 10001) / 10.0) AS BIGINT) AS tenths, o_orderkey % 4 AS k FROM orders)
    SELECT o_orderkey, (tenths // 10) || CASE WHEN tenths % 10 = 0 THEN '' ELSE '.' || (tenths % 10) END || '%' AS percent,
    CASE WHEN k = 0 THEN 'Blue Jig ' || o_orderkey WHEN k = 1 THEN 'Blue Jig ' || o_orderkey ELSE 'Real Name' END AS name, CASE WHEN k = 1 THEN '1 day' ELSE k || ' days' END AS days FROM t"""
)
def display_texts(spark, sf_dir):
    k = F.col("o_orderkey") % 4
    name = F.when(k == 0, "Unknown").when(k == 1, F.lit(None).cast("string")).otherwise(" Real Name")
    slug = F.concat(F.lit("blue-jig-"), F.col("o_orderkey").cast("string"))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", display.percent_text(F.col("o_custkey") % 10001).alias("percent"), display.repaired_name(name, slug).alias("name"), display.days_text(k).alias("days")
    )


REF = "strftime(TIMESTAMP '2024-05-01' + INTERVAL 1 MINUTE * page_id + INTERVAL 1 MICROSECOND * (page_id * 37 % 1000000), '%Y%m%dT%H%M%S%fZ') || '-task' || page_id || '-' || substr(sha256(html), 1, 16) || '.gz'"


def _ref():
    i = F.col("page_id")
    at = F.lit("2024-05-01").cast("timestamp") + F.make_dt_interval(mins=i.cast("int")) + F.make_dt_interval(secs=((i * 37) % 1000000).cast("decimal(18,6)") / 1000000)
    return make_ref(at, i, F.col("html"))


@query(f"SELECT page_id, {REF} AS ref FROM pages")
def snapshot_refs(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", _ref().alias("ref"))


@query(
    f"""SELECT page_id, {REF} AS ref, CASE WHEN page_id % 11 = 5 THEN NULL WHEN page_id % 10 = 0 THEN 404 ELSE 200 END AS status, CASE WHEN page_id % 11 <> 5 AND page_id % 10 <> 0 THEN sha256(html) END AS sha256,
    CASE WHEN page_id % 11 <> 5 AND page_id % 10 <> 0 THEN strlen(html) END AS body_bytes, CASE WHEN page_id % 11 = 5 THEN (['timeout', 'dns', 'tls', 'proxy', 'connection', 'connection'])[page_id % 6 + 1] END AS transport FROM pages"""
)
def landed_responses(spark, sf_dir):
    """Bodies landed as gzip files and read back as the answers to requests; some were never landed, some requests failed."""
    pages, i = table(spark, sf_dir, "pages"), F.col("page_id")
    folder = f"{_checkpoint(spark)}/landed"
    landed.land(pages.where(i % 10 != 0).select(_ref().alias("ref"), F.col("html").alias("body")), folder)
    errors = F.array(*map(F.lit, ("Read timed out", "getaddrinfo failed", "SSL: CERTIFICATE_VERIFY_FAILED", "Proxy CONNECT refused", "Connection reset by peer", "strange")))
    requests = pages.select("page_id", "url", _ref().alias("ref"), F.when(i % 11 == 5, F.element_at(errors, (i % 6 + 1).cast("int"))).alias("error"))
    got = landed.responses(requests, landed.landed(spark, folder))
    return got.select("page_id", "ref", "status", "sha256", F.octet_length("body").cast("bigint").alias("body_bytes"), "transport")


@query(
    """SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN '/p?page=' || o_custkey WHEN 1 THEN '/q/' || o_custkey END AS next,
    CASE WHEN o_orderkey % 2 = 0 THEN o_custkey * 100 + 99 END AS msrp_cents, CASE WHEN o_orderkey % 2 = 0 THEN 'very good' END AS wording FROM orders"""
)
def page_patterns(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    body = F.when(k % 3 == 0, F.concat(F.lit('<a class="n" rel="next" href="/p?page='), c, F.lit('">next</a>'))).when(k % 3 == 1, F.concat(F.lit('<link href="/q/'), c, F.lit('" rel="next">'))).otherwise("<a href='/x'>x</a>")
    told = F.when(k % 2 == 0, F.concat(F.lit("MSRP $"), c, F.lit(".99 - Very good condition. Handle worn."))).otherwise("Nice rod")
    made = table(spark, sf_dir, "orders").select("o_orderkey", next_page(body).alias("next"), used_wording(told).alias("u"))
    return made.select("o_orderkey", "next", "u.msrp_cents", "u.wording")


@query(
    """WITH l AS (SELECT o_orderkey AS listing_id, unnest([lpad(CAST(o_custkey AS VARCHAR), 14, '0'), lpad(CAST(o_orderkey % 97 + 9000 AS VARCHAR), 14, '0')]) AS g FROM orders),
    v AS (SELECT c_custkey AS variant_id, lpad(CAST(c_custkey * 3 AS VARCHAR), 14, '0') AS g FROM customer WHERE c_acctbal > 0),
    m AS (SELECT listing_id, min(variant_id) AS variant_id FROM l JOIN v USING (g) GROUP BY 1)
    SELECT o_orderkey AS listing_id, variant_id, CASE WHEN variant_id IS NULL THEN 'auto_created' ELSE 'auto_gtin' END AS match_status FROM orders LEFT JOIN m ON m.listing_id = o_orderkey"""
)
def match_cascade(spark, sf_dir):
    code = lambda c: F.lpad(c.cast("string"), 14, "0")
    listings = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("listing_id"), F.array(code(F.col("o_custkey")), code(F.col("o_orderkey") % 97 + 9000)).alias("gtin14"))
    variants = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("variant_id"), F.array(code(F.col("c_custkey") * 3)).alias("gtin14"), F.when(F.col("c_acctbal") <= 0, 1).alias("merged_into_id"))
    return catalog.match_listings(listings, variants)


@query(
    """WITH b AS (SELECT p_partkey AS product_id, regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g') AS base FROM part), n AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY product_id) AS k FROM b)
    SELECT product_id, CASE WHEN k = 1 THEN base ELSE base || '-' || k END AS slug FROM n"""
)
def slug_collisions(spark, sf_dir):
    products = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("product_id"), F.col("p_name").alias("name"))
    taken = spark.createDataFrame([], "slug string")
    return catalog.unique_slugs(products, taken).select("product_id", "slug")


@query(
    """SELECT CASE WHEN p_partkey % 2 = 0 THEN 'C' || p_partkey ELSE 'p' || p_partkey END AS sku, p_partkey % 3 = 0 AS on_clearance, CAST(round(p_retailprice * 100) AS BIGINT) AS price_cents
    FROM part WHERE p_size % 4 <> 0 AND p_size % 5 <> 0"""
)
def grid_eligibility(spark, sf_dir):
    k, cents = F.col("p_partkey"), F.round(F.col("p_retailprice") * 100).cast("bigint")
    rows = table(spark, sf_dir, "part").select(
        F.when(k % 2 == 0, F.concat(F.lit("C"), k.cast("string"))).otherwise("").alias("product_code"), F.col("p_name").alias("title"),
        F.concat(F.lit("https://h/x/p"), k.cast("string"), F.lit("/")).alias("product_url"), cents.alias("price_cents"), F.when(F.col("p_size") % 5 != 0, cents * 2).alias("claimed_cents"),
        (F.col("p_size") % 4 == 0).alias("price_is_range"), F.when(k % 3 == 0, "CLEARANCE_LISTING").otherwise("LISTING").alias("page_type"),
    )
    return catalog.grid_offers(rows).select("sku", "on_clearance", "price_cents")


@query("SELECT page_id, CASE WHEN page_id % 2 = 0 THEN lpad(CAST(page_id AS VARCHAR), 12, '7') || ',' || lpad(CAST(page_id AS VARCHAR), 8, '1') ELSE '' END AS codes FROM pages")
def barcode_walk(spark, sf_dir):
    i = F.col("page_id").cast("string")
    nested = F.to_json(F.struct(F.struct(F.lpad(i, 12, "7").alias("UPC"), F.array(F.struct(F.lpad(i, 8, "1").alias("gtin8"))).alias("list")).alias("a"), i.alias("other"), F.lpad(i, 12, "7").alias("barcode")))
    body = F.when(F.col("page_id") % 2 == 0, nested).otherwise(F.lit('{"upc": "12", "ean": "x"}'))
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(catalog.find_barcodes(body), ",").alias("codes"))
