"""Frontier, queue, upserts and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import work
from ..operators.latest import keyed_merge, latest_by, unseen
from ..sources.files import table
from .registering import query
from .star import shown_time


@query(
    """SELECT page_id FROM pages WHERE page_id % 4 = 0 OR TIMESTAMP '2024-01-01' + INTERVAL 1 MINUTE * (page_id % 500) + INTERVAL 240 MINUTE <= TIMESTAMP '2024-01-01 08:00:00'"""
)
def due_pages(spark, sf_dir):
    i = F.col("page_id")
    start = F.lit("2024-01-01").cast("timestamp")
    pages = table(spark, sf_dir, "pages").select("page_id", F.when(i % 4 != 0, start + F.make_dt_interval(mins=(i % 500).cast("int"))).alias("last_swept"), F.lit(240).alias("interval_minutes"))
    return work.due_pages(pages, F.lit("2024-01-01 08:00:00").cast("timestamp")).select("page_id")


TASKS = """tasks AS (SELECT o_orderkey AS task_id, o_custkey % 25 AS retailer_id, o_orderpriority AS priority, o_orderdate AS not_before, CASE o_orderstatus WHEN 'O' THEN 'QUEUED' WHEN 'F' THEN 'DONE' ELSE 'LEASED' END AS status FROM orders)"""


def tasks(spark, sf_dir):
    status = F.col("o_orderstatus")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("task_id"),
        (F.col("o_custkey") % 25).alias("retailer_id"),
        F.col("o_orderpriority").alias("priority"),
        F.col("o_orderdate").cast("timestamp").alias("not_before"),
        F.when(status == "O", "QUEUED").when(status == "F", "DONE").otherwise("LEASED").alias("status"),
    )


@query(f"WITH {TASKS} SELECT task_id, retailer_id, priority FROM tasks WHERE status = 'QUEUED' QUALIFY row_number() OVER (PARTITION BY retailer_id ORDER BY priority, not_before, task_id) <= 8")
def queue_topk(spark, sf_dir):
    return work.queue_topk(tasks(spark, sf_dir), 8).select("task_id", "retailer_id", "priority")


@query(
    f"""WITH {TASKS}, batch AS (SELECT event_id AS task_id, user_id % 700 || '-' || event_type AS dedupe_key FROM events),
    open AS (SELECT DISTINCT task_id % 700 || '-click' AS dedupe_key FROM tasks WHERE status IN ('QUEUED', 'LEASED'))
    SELECT min(task_id) AS task_id, dedupe_key FROM batch WHERE dedupe_key NOT IN (SELECT dedupe_key FROM open) GROUP BY dedupe_key"""
)
def open_task_dedupe(spark, sf_dir):
    queue = tasks(spark, sf_dir).select(F.concat((F.col("task_id") % 700).cast("string"), F.lit("-click")).alias("dedupe_key"), "status")
    batch = table(spark, sf_dir, "events").select(F.col("event_id").alias("task_id"), F.concat((F.col("user_id") % 700).cast("string"), F.lit("-"), "event_type").alias("dedupe_key"))
    return work.enqueue(batch, queue).select("task_id", "dedupe_key")


@query(
    """WITH cur AS (SELECT p_partkey AS sku, p_name AS title, p_size AS stock, CASE WHEN p_partkey % 3 = 0 THEN p_partkey END AS variant FROM part WHERE p_partkey % 2 = 0),
    batch AS (SELECT p_partkey AS sku, 'new ' || p_name AS title, p_size + 1 AS stock, p_partkey * 10 AS variant FROM part WHERE p_partkey % 5 <> 0)
    SELECT coalesce(c.sku, b.sku) AS sku, coalesce(b.title, c.title) AS title, coalesce(b.stock, c.stock) AS stock, coalesce(c.variant, b.variant) AS variant, b.sku IS NOT NULL AS active
    FROM cur c FULL JOIN batch b ON c.sku = b.sku"""
)
def listing_upsert_merge(spark, sf_dir):
    """Parsed fields are overwritten, a variant once matched is kept, what was seen is active."""
    part = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    current = part.where(k % 2 == 0).select(k.alias("sku"), F.col("p_name").alias("title"), F.col("p_size").alias("stock"), F.when(k % 3 == 0, k).alias("variant"))
    batch = part.where(k % 5 != 0).select(k.alias("sku"), F.concat(F.lit("new "), "p_name").alias("title"), (F.col("p_size") + 1).alias("stock"), (k * 10).alias("variant"))
    pick = lambda a, b, n: F.coalesce(F.col(f"{a}.{n}"), F.col(f"{b}.{n}"))
    rules = {"title": pick("b", "c", "title"), "stock": pick("b", "c", "stock"), "variant": pick("c", "b", "variant"), "active": F.col("b.sku").isNotNull()}
    return keyed_merge(current, batch, ["sku"], rules)


@query(
    """WITH cur AS (SELECT page_id AS id, CASE WHEN page_id % 3 <> 0 THEN TIMESTAMP '2024-01-01' END AS expires, page_id % 7 <> 0 AS enabled FROM pages WHERE page_id % 2 = 0),
    seen AS (SELECT page_id AS id FROM pages WHERE page_id % 5 < 3)
    SELECT coalesce(c.id, s.id) AS id, strftime(CASE WHEN s.id IS NULL THEN c.expires WHEN c.id IS NULL OR c.expires IS NOT NULL THEN TIMESTAMP '2024-03-01' + INTERVAL 120 DAY END, '%Y-%m-%d %H:%M:%S') AS expires,
    s.id IS NOT NULL OR c.enabled AS enabled FROM cur c FULL JOIN seen s ON c.id = s.id"""
)
def url_ttl_upsert(spark, sf_dir):
    """Seeing a URL again enables it and extends its time to live where it had one."""
    pages, i = table(spark, sf_dir, "pages"), F.col("page_id")
    moment = lambda text: F.lit(text).cast("timestamp")
    current = pages.where(i % 2 == 0).select(i.alias("id"), F.when(i % 3 != 0, moment("2024-01-01 00:00:00")).alias("expires"), (i % 7 != 0).alias("enabled"))
    seen = pages.where(i % 5 < 3).select(i.alias("id"))
    later = moment("2024-03-01 00:00:00") + F.expr("INTERVAL 120 DAYS")
    extended = F.when(F.col("c.id").isNull() | F.col("c.expires").isNotNull(), later)
    rules = {"expires": F.when(F.col("b.id").isNull(), F.col("c.expires")).otherwise(extended), "enabled": F.col("b.id").isNotNull() | F.col("c.enabled")}
    return keyed_merge(current, seen, ["id"], rules).withColumn("expires", shown_time(F.col("expires")))


@query(
    """WITH b AS (SELECT event_id, user_id AS offer_id, CASE WHEN event_type = 'error' THEN '' ELSE event_type END AS ref FROM events WHERE event_id % 2 = 0),
    s AS (SELECT DISTINCT user_id AS offer_id, event_type AS ref FROM events WHERE event_id % 31 = 1)
    SELECT event_id FROM b WHERE ref = '' UNION ALL
    SELECT min(event_id) FROM b WHERE ref <> '' AND (offer_id, ref) NOT IN (SELECT (offer_id, ref) FROM s) GROUP BY offer_id, ref"""
)
def observation_dedupe(spark, sf_dir):
    """A snapshot is taken once per offer; an empty reference is never taken as seen."""
    events = table(spark, sf_dir, "events")
    ref = F.when(F.col("event_type") == "error", "").otherwise(F.col("event_type"))
    batch = events.where("event_id % 2 = 0").select("event_id", F.col("user_id").alias("offer_id"), ref.alias("ref"))
    stored = events.where("event_id % 31 = 1").select(F.col("user_id").alias("offer_id"), F.col("event_type").alias("ref"))
    return unseen(batch, stored, ["offer_id", "ref"], [F.asc("event_id")], F.col("ref") == "").select("event_id")


@query("SELECT event_id AS capture_id, user_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 100")
def newest_n(spark, sf_dir):
    return table(spark, sf_dir, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(100).select(F.col("event_id").alias("capture_id"), "user_id")


ORDERED = "row_number() OVER (ORDER BY {o}) AS place"


@query("SELECT l_partkey, l_suppkey, l_linenumber, l_orderkey, l_discount FROM lineitem ORDER BY l_discount DESC, l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, l_partkey, l_suppkey LIMIT 200")
def feed_order(spark, sf_dir):
    """The feed's first page: deepest discount first, then newest."""
    order = [F.desc("l_discount"), F.desc("l_shipdate"), F.desc("l_orderkey"), F.desc("l_linenumber"), F.asc("l_partkey"), F.asc("l_suppkey")]
    return table(spark, sf_dir, "lineitem").orderBy(*order).limit(200).select("l_partkey", "l_suppkey", "l_linenumber", "l_orderkey", "l_discount")


@query(
    """SELECT o_orderkey, o_orderstatus FROM orders
    QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'P' THEN 1 ELSE 2 END, o_totalprice DESC, o_orderkey) = 1"""
)
def lane_order(spark, sf_dir):
    lane = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "P", 1).otherwise(2)
    return latest_by(table(spark, sf_dir, "orders"), ["o_custkey"], [lane.asc(), F.desc("o_totalprice"), F.asc("o_orderkey")]).select("o_orderkey", "o_orderstatus")


@query(
    """SELECT event_id, event_type = 'view' OR sum(CASE WHEN event_type = 'view' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) <= 10 AS enrolled FROM events"""
)
def enrolment_cap(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    items = events.select("event_id", "user_id", F.col("event_id").alias("ord"), (F.col("event_type") == "view").alias("known"))
    room = events.select("user_id").distinct().withColumn("free", F.lit(10))
    return work.capped(items, room, "user_id").select("event_id", "enrolled")


@query(
    """SELECT o_orderkey AS task_id FROM orders WHERE o_orderstatus IN ('O', 'P') AND o_orderdate + INTERVAL 3 HOUR < TIMESTAMP '1998-01-01'"""
)
def confirm_deadline_sweep(spark, sf_dir):
    rows = tasks(spark, sf_dir).withColumns({"kind": F.lit("CONFIRM"), "deadline": F.col("not_before") + F.expr("INTERVAL 3 HOURS")})
    return work.overdue(rows, F.lit("1998-01-01").cast("timestamp")).select("task_id")


BUDGET = f"""WITH {TASKS}, t AS (
  SELECT *, (retailer_id * 7) % 25 AS ord, 10 + retailer_id % 5 AS cost, row_number() OVER (PARTITION BY retailer_id ORDER BY priority, not_before, task_id) AS turn FROM tasks WHERE status = 'QUEUED' QUALIFY turn <= 8
), s AS (SELECT retailer_id, coalesce(sum(sum(cost)) OVER (ORDER BY ord, retailer_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begins FROM t GROUP BY ord, retailer_id)"""


def _budget_tasks(spark, sf_dir):
    r = F.col("retailer_id")
    return tasks(spark, sf_dir).where("status = 'QUEUED'").withColumns({"ord": (r * 7) % 25, "cost_seconds": 10 + r % 5})


@query(f"{BUDGET} SELECT task_id, t.retailer_id, turn, CAST(begins + coalesce(sum(cost) OVER (PARTITION BY t.retailer_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS starts_at, begins < 1500 AS runs FROM t JOIN s USING (retailer_id)")
def run_budget(spark, sf_dir):
    """A run of 25 minutes: shops one after the other, none begun past the deadline."""
    return work.run_budget(_budget_tasks(spark, sf_dir)).select("task_id", "retailer_id", F.col("turn").cast("bigint").alias("turn"), F.col("starts_at").cast("bigint").alias("starts_at"), "runs")


@query(f"{BUDGET}, c AS (SELECT *, CAST(coalesce(sum(cost) OVER (ORDER BY turn, ord, retailer_id, task_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS starts_at FROM t) SELECT task_id, retailer_id, turn, starts_at, starts_at < 1500 AS runs FROM c")
def run_budget_in_turns(spark, sf_dir):
    """The same run with shops taking turns."""
    return work.run_budget(_budget_tasks(spark, sf_dir), round_robin=True).select("task_id", "retailer_id", F.col("turn").cast("bigint").alias("turn"), F.col("starts_at").cast("bigint").alias("starts_at"), "runs")
