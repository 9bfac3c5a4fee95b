"""Scalar functions over the test tables' names, keys, texts and times."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import gtin, money, text, times, web
from ..functions.basics import lookup
from ..sources.files import table
from ..sources.markup import links_of, stock_cell, title_of
from .registering import query


@query(
    """WITH r AS (SELECT o_orderkey, 'was $' || CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_custkey AS VARCHAR) || ',' || lpad(CAST(o_orderkey % 1000 AS VARCHAR), 3, '0') ELSE CAST(o_custkey AS VARCHAR) END
      || CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN '.5' ELSE '.' || lpad(CAST(o_orderkey % 100 AS VARCHAR), 2, '0') END AS raw FROM orders
    ), p AS (SELECT o_orderkey, CAST(replace(regexp_extract(raw, '\\$?\\s*(\\d[\\d,]*)(\\.\\d{1,2})?', 1), ',', '') AS BIGINT) * 100
      + coalesce(TRY_CAST(rpad(replace(regexp_extract(raw, '\\$?\\s*(\\d[\\d,]*)(\\.\\d{1,2})?', 2), '.', ''), 2, '0') AS BIGINT), 0) AS cents FROM r)
    SELECT o_orderkey, CASE WHEN cents > 0 THEN cents END AS cents, CASE WHEN cents > 0 THEN '$' || (cents // 100) || '.' || lpad(CAST(cents % 100 AS VARCHAR), 2, '0') END AS shown FROM p"""
)
def parse_price(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    whole = F.when(k % 3 == 0, F.concat(c, F.lit(","), F.lpad((k % 1000).cast("string"), 3, "0"))).otherwise(c)
    part = F.when(k % 4 == 0, "").when(k % 4 == 1, ".5").otherwise(F.concat(F.lit("."), F.lpad((k % 100).cast("string"), 2, "0")))
    cents = money.parse_price_cents(F.concat(F.lit("was $"), whole, part))
    return table(spark, sf_dir, "orders").select("o_orderkey", cents.alias("cents")).withColumn("shown", money.format_cents(F.col("cents")))


@query(
    """SELECT p_partkey, coalesce(nullif(regexp_replace(regexp_replace(lower(p_name || ' / ' || p_brand), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'item') AS slug,
    nullif(regexp_replace(regexp_replace(lower(p_brand), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), '') AS brand FROM part"""
)
def slugify(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", text.slugify(F.concat("p_name", F.lit(" / "), "p_brand")).alias("slug"), text.brand_key(F.col("p_brand")).alias("brand"))


@query(
    """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'length_in=' || p_size || '|color_key=' || lower(p_brand)
      WHEN 1 THEN CASE WHEN p_size % 2 = 0 THEN 'line_type=mono|lb_test=' || p_size || '|yards=' || (p_size * 10) || '|color_key=' || lower(p_brand) END END AS variant_key FROM part"""
)
def variant_key(spark, sf_dir):
    size, kind = F.col("p_size"), F.col("p_partkey") % 4
    category = F.when(kind == 0, "hard_bait").when(kind == 1, "line").when(kind == 2, "other").otherwise("unknown")
    attributes = F.create_map(
        F.lit("length_in"), size.cast("string"), F.lit("color_key"), F.lower("p_brand"), F.lit("line_type"), F.lit("mono"),
        F.lit("lb_test"), F.when(size % 2 == 0, size.cast("string")).otherwise(""), F.lit("yards"), (size * 10).cast("string"),
    )
    return table(spark, sf_dir, "part").select("p_partkey", text.variant_key(category, attributes).alias("variant_key"))


@query(
    """WITH d AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN lpad(CAST(o_orderkey * 7919 AS VARCHAR), 12, '0') WHEN 1 THEN lpad(CAST(o_orderkey * 104729 AS VARCHAR), 13, '3')
      WHEN 2 THEN lpad(CAST(o_orderkey AS VARCHAR), 8, '4') ELSE CAST(o_orderkey AS VARCHAR) END AS digits FROM orders
    ), p AS (SELECT *, lpad(digits, 14, '0') AS g FROM d), w AS (
      SELECT *, list_sum(list_transform(range(1, 14), lambda i: CAST(substr(g, CAST(i AS INT), 1) AS INT) * CASE WHEN i % 2 = 1 THEN 3 ELSE 1 END)) AS s FROM p)
    SELECT o_orderkey, CASE WHEN length(digits) IN (8, 12, 13, 14) AND (10 - s % 10) % 10 = CAST(substr(g, 14, 1) AS INT) THEN g END AS gtin14 FROM w"""
)
def gtin_checksum(spark, sf_dir):
    k = F.col("o_orderkey")
    raw = (
        F.when(k % 4 == 0, F.lpad((k * 7919).cast("string"), 12, "0"))
        .when(k % 4 == 1, F.lpad((k * 104729).cast("string"), 13, "3"))
        .when(k % 4 == 2, F.lpad(k.cast("string"), 8, "4"))
        .otherwise(k.cast("string"))
    )
    dashed = F.concat(F.substring(raw, 1, 3), F.lit("-"), F.substring(raw, 4, 99))
    return table(spark, sf_dir, "orders").select("o_orderkey", gtin.normalize_gtin(dashed).alias("gtin14"))


@query(
    """SELECT p_partkey, CASE WHEN p_partkey % 3 <> 2 THEN CAST(p_size AS INT) END AS packs FROM part"""
)
def pack_count(spark, sf_dir):
    size, kind = F.col("p_size").cast("string"), F.col("p_partkey") % 3
    title = F.concat("p_name", F.lit(" "), size, F.when(kind == 0, "-Pack").when(kind == 1, "ct").otherwise(" pieces"))
    return table(spark, sf_dir, "part").select("p_partkey", text.pack_count(title).alias("packs"))


@query("SELECT p_partkey, CAST(p_size % 9 * 12 + CASE WHEN p_partkey % 2 = 0 THEN p_size % 12 ELSE 0 END AS INT) AS inches, CASE p_partkey % 3 WHEN 0 THEN 'MH' WHEN 1 THEN 'UL' END AS power, CASE p_partkey % 3 WHEN 0 THEN 'F' WHEN 1 THEN 'XF' END AS action FROM part")
def rod_length(spark, sf_dir):
    size, kind = F.col("p_size"), F.col("p_partkey") % 3
    raw = F.concat((size % 9).cast("string"), F.lit("'"), F.when(F.col("p_partkey") % 2 == 0, F.concat((size % 12).cast("string"), F.lit('"'))).otherwise(""))
    style = F.when(kind == 0, "Medium Heavy - Fast").when(kind == 1, "UL - Extra Fast").otherwise("Fast")
    return table(spark, sf_dir, "part").select("p_partkey", text.rod_length_in(raw).alias("inches"), text.rod_power(style).alias("power"), text.rod_action(style).alias("action"))


@query(
    """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'NEW' WHEN 1 THEN 'USED_LIKE_NEW' WHEN 2 THEN 'USED_GOOD' WHEN 3 THEN NULL ELSE 'USED_ACCEPTABLE' END AS condition,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'FIRST_PARTY' WHEN '2-HIGH' THEN 'MARKETPLACE' END AS seller FROM orders"""
)
def condition_map(spark, sf_dir):
    k = F.col("o_orderkey") % 5
    wording = F.when(k == 0, " ").when(k == 1, " Excellent").when(k == 2, "GOOD ").when(k == 3, "shiny").otherwise("fair")
    seller = lookup({"1-URGENT": "FIRST_PARTY", "2-HIGH": "MARKETPLACE"}, F.col("o_orderpriority"))
    return table(spark, sf_dir, "orders").select("o_orderkey", text.condition_of(wording).alias("condition"), seller.alias("seller"))


@query(
    """WITH u AS (SELECT page_id, url, lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]+)', 1)) AS host, 'https://fallback.example.com/' || page_id AS other FROM pages)
    SELECT page_id, host, array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') AS domain,
      CASE WHEN url LIKE 'https://%' AND (host LIKE '%.example.com' OR host LIKE 'm.%') THEN url WHEN page_id % 2 = 0 THEN other END AS safe FROM u"""
)
def url_host_allowlist(spark, sf_dir):
    """Each page's URL, or its fallback, if it is https on an allowed host."""
    host = web.host_of(F.col("url"))
    own = F.when(host.endswith(".example.com") | host.startswith("m."), F.array(host, F.lit("fallback.example.com"))).otherwise(F.array(F.lit("fallback.example.com")))
    other = F.concat(F.when(F.col("page_id") % 2 == 0, "https").otherwise("http"), F.lit("://fallback.example.com/"), F.col("page_id").cast("string"))
    return table(spark, sf_dir, "pages").select("page_id", host.alias("host"), web.registrable_domain(host).alias("domain"), web.safe_url(F.col("url"), other, own).alias("safe"))


@query(
    """SELECT doc_id, sha256(regexp_replace(regexp_replace(text || ' postgres://u:p@h/db?x=1 PWD=x;', '://[^/@\\s]+:[^/@\\s]+@', '://[REDACTED]@', 'g'),
    '(?i)\\b(password|passwd|pwd|api[_-]?key|secret|token|access[_-]?key)\\s*=\\s*[^&\\s;]+', '\\1=[REDACTED]', 'g')) AS redacted FROM documents"""
)
def redact(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    raw = F.concat("text", F.lit(" postgres://u:p@h/db?x=1 PWD=x;"))
    return docs.select("doc_id", F.sha2(web.redact(raw).cast("binary"), 256).alias("redacted"))


@query(
    """SELECT event_id, CAST((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS DATE) AS eastern_day FROM events"""
)
def et_calendar_day(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", times.eastern_day(F.col("ts").cast("timestamp")).alias("eastern_day"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS stamp, strftime(ts, '%Y-%m-%dT%H:%M') AS minute FROM events")
def iso_z_format(spark, sf_dir):
    ts = F.col("ts").cast("timestamp")
    return table(spark, sf_dir, "events").select("event_id", times.iso_z(ts).alias("stamp"), times.minute_bucket(ts).alias("minute"))


@query(
    """WITH t AS (SELECT event_id, ts, (SELECT max(ts) FROM events) AS now FROM events), s AS (SELECT *, CAST(floor(epoch(now)) - floor(epoch(ts)) AS BIGINT) AS n FROM t)
    SELECT event_id, CASE WHEN n < 60 THEN 'just now' WHEN n < 3600 THEN n // 60 || ' min ago' WHEN n < 86400 THEN n // 3600 || ' h ago' ELSE n // 86400 || ' d ago' END AS ago FROM s"""
)
def relative_time(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    newest = F.broadcast(events.agg(F.max("ts").alias("now")))
    return events.join(newest).select("event_id", times.ago_text(F.col("ts"), F.col("now")).alias("ago"))


@query(
    """SELECT page_id, nullif(trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\\s+', ' ', 'g')), '') AS title,
    len(list_distinct(regexp_extract_all(html, '(?i)<a\\s[^>]*href="([^"]*)"', 1))) AS links FROM pages"""
)
def page_title_links(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", title_of(F.col("html")).alias("title"), F.size(links_of(F.col("html"))).cast("bigint").alias("links"))


@query(
    """WITH p AS (SELECT page_id, CAST(CASE page_id % 7 WHEN 0 THEN 403 WHEN 1 THEN 404 ELSE 200 END AS INT) AS status, html,
      CASE WHEN contains(lower(html), 'captcha') THEN 'captcha' END AS sig FROM pages)
    SELECT page_id, CASE WHEN sig IS NOT NULL OR status = 403 THEN 'BLOCKED' WHEN status = 404 THEN 'NOT_FOUND' WHEN NOT contains(html, '<article') THEN 'EMPTY' ELSE 'OK' END AS outcome,
      coalesce(sig, CASE WHEN status = 403 THEN 'http_403' END) AS signature FROM p"""
)
def page_outcome(spark, sf_dir):
    status = F.when(F.col("page_id") % 7 == 0, 403).when(F.col("page_id") % 7 == 1, 404).otherwise(200)
    done = table(spark, sf_dir, "pages").select("page_id", web.page_outcome(status, F.col("html"), ("<article",)).alias("o"))
    return done.select("page_id", "o.outcome", "o.signature")


@query(
    """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN CAST(o_orderkey % 50 AS INT) WHEN 1 THEN CAST(o_orderkey % 50 AS INT) END AS quantity, o_orderkey % 5 = 1 AS is_floor,
    CASE WHEN o_orderkey % 5 < 2 AND o_orderkey % 50 > 0 THEN 'IN_STOCK' WHEN o_orderkey % 5 IN (2, 3) THEN 'BACKORDER' WHEN o_orderkey % 50 = 0 THEN 'OUT_OF_STOCK' ELSE 'UNKNOWN' END AS availability FROM orders"""
)
def stock_grammar(spark, sf_dir):
    k, n = F.col("o_orderkey") % 5, (F.col("o_orderkey") % 50).cast("string")
    cell = F.when(k == 0, n).when(k == 1, F.concat(n, F.lit("+"))).when(k == 2, "09/20").when(k == 3, "14 Days").otherwise("call")
    return table(spark, sf_dir, "orders").select("o_orderkey", stock_cell(cell).alias("s")).select("o_orderkey", "s.quantity", "s.is_floor", "s.availability")


@query(
    """WITH a AS (SELECT c_custkey, c_custkey % 256 AS a1, c_custkey // 3 % 256 AS b1, c_custkey % 7 AS c1 FROM customer), n AS (
      SELECT c_custkey, ((a1 * 256 + b1) * 256 + c1) * 256 + 1 AS ip FROM a)
    SELECT c_custkey, ip BETWEEN 0 AND 16777215 OR ip BETWEEN 167772160 AND 184549375 OR ip BETWEEN 1681915904 AND 1686110207 OR ip BETWEEN 2130706432 AND 2147483647 OR ip BETWEEN 2851995648 AND 2852061183
      OR ip BETWEEN 2886729728 AND 2887778303 OR ip BETWEEN 3221225472 AND 3221225727 OR ip BETWEEN 3221225984 AND 3221226239 OR ip BETWEEN 3232235520 AND 3232301055 OR ip BETWEEN 3323068416 AND 3323199487
      OR ip BETWEEN 3325256704 AND 3325256959 OR ip BETWEEN 3405803776 AND 3405804031 OR ip >= 3758096384 AS blocked FROM n"""
)
def blocked_networks(spark, sf_dir):
    k = F.col("c_custkey")
    ip = F.concat_ws(".", (k % 256).cast("string"), (F.expr("c_custkey div 3") % 256).cast("string"), (k % 7).cast("string"), F.lit("1"))
    return table(spark, sf_dir, "customer").select("c_custkey", web.blocked_ipv4(ip).alias("blocked"))
