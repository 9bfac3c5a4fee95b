"""Crawl frontier and work queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .latest import latest_by


def due_pages(pages: DataFrame, now: Column) -> DataFrame:
    """Pages never swept or whose interval has passed (last_swept, interval_minutes)."""
    return pages.where(F.col("last_swept").isNull() | (F.col("last_swept") + F.make_dt_interval(mins=F.col("interval_minutes")) <= now))


def queue_topk(tasks: DataFrame, k: int, group: str = "retailer_id") -> DataFrame:
    """The next k open tasks of each retailer by priority, then time, then id."""
    return latest_by(tasks.where("status = 'QUEUED'"), [group], [F.asc("priority"), F.asc("not_before"), F.asc("task_id")], k)


def enqueue(batch: DataFrame, queue: DataFrame) -> DataFrame:
    """Tasks of a batch whose dedupe_key has no open task and is first in the batch."""
    open_keys = queue.where("status in ('QUEUED', 'LEASED')").select("dedupe_key").distinct()
    return latest_by(batch.join(open_keys, "dedupe_key", "left_anti"), ["dedupe_key"], [F.asc("task_id")])


def overdue(tasks: DataFrame, now: Column) -> DataFrame:
    """Open confirmation tasks past their deadline, expired."""
    return tasks.where("kind = 'CONFIRM' and status in ('QUEUED', 'LEASED')").where(F.col("deadline") < now).withColumn("status", F.lit("EXPIRED"))


def expired_urls(urls: DataFrame, open_deals: DataFrame, now: Column, keys: tuple[str, ...] = ("retailer_id", "url")) -> DataFrame:
    """Enabled URLs past their time to live that no open deal needs; ``keys`` tell which URL a deal needs."""
    return urls.where("enabled").where(F.col("expires_at") < now).join(open_deals.select(*keys).distinct(), list(keys), "left_anti")


def stale_deals(deals: DataFrame, observations: DataFrame, now: Column, hours: int) -> DataFrame:
    """Active deals without an OK observation of their offer in the last hours."""
    fresh = observations.where("quality = 'OK'").where(F.col("observed_at") >= now - F.expr(f"INTERVAL {hours} HOURS")).select("offer_id").distinct()
    return deals.where("status = 'ACTIVE'").join(fresh, "offer_id", "left_anti")


def capped(items: DataFrame, room: DataFrame, group: str = "retailer_id") -> DataFrame:
    """Enrolment in order until a retailer's room is used up; known items use none.

    Adds ``enrolled``. ``room`` has the group and its free places.
    """
    w = Window.partitionBy(group).orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    used = F.sum(F.when(F.col("known"), 0).otherwise(1)).over(w)
    return items.join(room, group).withColumn("enrolled", F.col("known") | (used <= F.col("free")))


def with_fallback(stored: DataFrame, configured: DataFrame, group: str = "retailer") -> DataFrame:
    """Stored rows, and configured ones for groups that have none stored (same columns)."""
    absent = configured.join(stored.select(group).distinct(), group, "left_anti")
    return stored.unionByName(absent)


def seeded(values: DataFrame, parents: DataFrame, stored: DataFrame, key: list[str]) -> DataFrame:
    """Seed rows whose parent exists and whose key is not stored yet."""
    return values.join(parents.select("retailer", "retailer_id"), "retailer").join(stored.select(*key), key, "left_anti")


def promoted(tasks: DataFrame, variants: DataFrame, now: Column, priority: int = 10) -> DataFrame:
    """Tasks of the given variants made urgent: priority at least this high, due now at the latest."""
    hot = variants.select("variant_id").distinct().withColumn("hot_", F.lit(True))
    joined = tasks.join(hot, "variant_id", "left")
    due = F.when(F.col("hot_"), F.least("not_before", now)).otherwise(F.col("not_before"))
    rank = F.when(F.col("hot_"), F.least("priority", F.lit(priority))).otherwise(F.col("priority"))
    return joined.withColumns({"not_before": due, "priority": rank}).drop("hot_")


def run_budget(tasks: DataFrame, cap: int = 8, deadline_seconds: float = 1500.0, round_robin: bool = False) -> DataFrame:
    """The tasks that one run may take up, with ``turn`` (a shop's first is 1), ``starts_at`` (seconds into the
    run) and ``runs``.

    ``tasks`` have retailer_id, ord (the shops' order), task_id, priority, not_before and cost_seconds.
    Each shop gives at most ``cap`` tasks. Shops are worked off one after the other, and one that has
    not begun by the deadline is left for the next run as a whole; in ``round_robin`` shops take turns
    and each task must begin before the deadline, so that a slow shop doesn't keep the others
    waiting. What is ordered as a whole is at most ``cap`` tasks of each shop.
    """
    mine = Window.partitionBy("retailer_id").orderBy("priority", "not_before", "task_id")
    chosen = tasks.withColumn("turn", F.row_number().over(mine)).where(F.col("turn") <= cap)
    if round_robin:
        whole = Window.orderBy("turn", "ord", "retailer_id", "task_id").rowsBetween(Window.unboundedPreceding, -1)
        timed = chosen.withColumn("starts_at", F.coalesce(F.sum("cost_seconds").over(whole), F.lit(0)))
        return timed.withColumn("runs", F.col("starts_at") < deadline_seconds)
    shops = chosen.groupBy("ord", "retailer_id").agg(F.sum("cost_seconds").alias("cost"))
    before = Window.orderBy("ord", "retailer_id").rowsBetween(Window.unboundedPreceding, -1)
    begun = shops.select("retailer_id", F.coalesce(F.sum("cost").over(before), F.lit(0)).alias("begins_at"))
    within = Window.partitionBy("retailer_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    timed = chosen.join(begun, "retailer_id").withColumn("starts_at", F.col("begins_at") + F.coalesce(F.sum("cost_seconds").over(within), F.lit(0)))
    return timed.withColumn("runs", F.col("begins_at") < deadline_seconds).drop("begins_at")
