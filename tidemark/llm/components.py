"""Connected components of a link table by alternating large-star and small-star steps.

Every step is a minimum with partial aggregation and a join. A node with very many links is looked
up by broadcast (there are few such nodes, whatever the size of the table), so its links are not
gathered in one task. Each step is checkpointed; the rounds end when the links are stars.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, hot_join

LINKS_PER_TASK = 200_000


def _rows(*pairs: Column) -> Column:
    """Several rows in place of one; null ones are left out. Unlike a union it keeps a frame in its one task."""
    return F.inline(F.filter(F.array(*pairs), lambda x: x.isNotNull()))


def _pair(hi: str, lo: str) -> Column:
    return F.struct(F.col(hi).alias("hi"), F.col(lo).alias("lo"))


def _with_least(links: DataFrame, total: int) -> DataFrame:
    """The links (hi, lo), at most ``total``, with the least lo of their hi as m."""
    if total < LINKS_PER_TASK:
        # In a single task nothing is dealt by key, so no key is too large for it; a join would be dealt.
        return links.withColumn("m", F.min("lo").over(Window.partitionBy("hi")))
    least = links.groupBy("hi").agg(F.min("lo").alias("m"), F.count("*").alias("n_"))
    return hot_join(links, least, ["hi"], "n_", total).drop("n_")


def _hang(links: DataFrame, total: int) -> DataFrame:
    """One large-star and one small-star step; links are (hi, lo) with hi > lo, as are the results.

    Up to LINKS_PER_TASK rows stay in one task throughout: dealt to all shuffle partitions, each step
    would be hundreds of tasks of a few rows, whose reports fill the driver's memory.
    """
    few = 1 + 2 * total // LINKS_PER_TASK
    met = _with_least(links.coalesce(few).select(_rows(_pair("hi", "lo"), _pair("lo", "hi"))), 2 * total)
    met = met.withColumn("to", F.least("hi", "m"))
    large = met.select(_rows(F.when(F.col("lo") > F.col("hi"), _pair("lo", "to")), F.when(F.col("m") < F.col("hi"), _pair("hi", "m"))))
    large = cut(large.distinct().coalesce(few)).coalesce(few)
    met = _with_least(large, 2 * total)
    return met.select(_rows(F.when(F.col("lo") > F.col("m"), _pair("lo", "m")), _pair("hi", "m"))).distinct()


def _state(links: DataFrame) -> tuple[int, bool]:
    """The number of links, and whether every node hangs from one node that hangs from none: then
    the stars are the components."""
    end = lambda x, up: F.struct(F.col(x).alias("x"), F.lit(up).alias("up"), F.lit(1 - up).alias("down"))
    seen = links.select(_rows(end("hi", 1), end("lo", 0))).groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    n, stray = seen.agg(F.sum("up"), F.max(((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0))).cast("int"))).first()
    return n or 0, not stray


def connected_components(links: DataFrame, rows: int | None = None) -> DataFrame:
    """(node, component) for every node of ``links`` (columns a, b); the component is its least node.

    Self links and repeated links are allowed; null ends are dropped. No links: no rows. ``rows`` is
    the number of links, if it is known; then they are read in as few tasks as that needs.
    """
    if rows is not None:
        links = links.coalesce(1 + rows // LINKS_PER_TASK)
    now = cut(
        links.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
        .distinct(),
        rows,
    )
    if rows is not None:
        now = now.coalesce(1 + rows // LINKS_PER_TASK)
    total, done = _state(now)
    while not done:
        # Read back in tasks of a fair size: links may be few and spread over many partitions.
        few = 1 + total // LINKS_PER_TASK
        now = cut(_hang(now, total).coalesce(few)).coalesce(few)
        total, done = _state(now)
    now = now.coalesce(1 + total // LINKS_PER_TASK)
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(now.select("lo", "lo").distinct())
