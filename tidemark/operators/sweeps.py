"""Sweeps of listing pages: when a page was fetched through, and what each pass over it held."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

COUNTS = ("variants", "prices", "previous_variants", "previous_prices")
#: Most rows of a table that is broadcast to be looked up; a page's fetch times and sweeps are few beside its rows.
FEW = 500_000


def sessions(rows: DataFrame, gap_seconds: float) -> DataFrame:
    """(page_key, observed_at, sweep): gaps and islands of a page's fetches.

    A fetch more than ``gap_seconds`` after the page's one before begins a new sweep. What is ordered
    by page are its distinct fetch times, however many rows a fetch gave.
    """
    fetches = rows.where("page_key is not null and observed_at is not null").select("page_key", "observed_at").distinct()
    ordered = Window.partitionBy("page_key").orderBy("observed_at")
    before = F.lag("observed_at").over(ordered)
    starts = F.coalesce((F.unix_micros("observed_at") - F.unix_micros(before) > int(gap_seconds * 1_000_000)).cast("long"), F.lit(1).cast("long"))
    return fetches.withColumn("starts", starts).withColumn("sweep", F.sum("starts").over(ordered)).drop("starts")


def looked_up(facts: DataFrame, keys: DataFrame) -> DataFrame:
    """``facts``, one row for each of ``keys``, to be broadcast if they are few: then the rows that look them up stay where
    they are. Spark itself sees how few they are only after it has shuffled those rows."""
    return F.broadcast(facts) if keys.count() <= FEW else facts


def counted_sweeps(placed: DataFrame) -> DataFrame:
    """One row for each page and sweep: distinct variants and prices, and those of the sweep before."""
    counts = placed.groupBy("page_key", "sweep").agg(F.count_distinct("variant_key").alias("variants"), F.count_distinct("price_cents").alias("prices"))
    ordered = Window.partitionBy("page_key").orderBy("sweep")
    return counts.withColumns({f"previous_{c}": F.lag(c).over(ordered) for c in ("variants", "prices")})


def with_sweep_counts(rows: DataFrame, gap_seconds: float | None = None) -> DataFrame:
    """``rows`` with ``sweep``, ``variants``, ``prices``, ``previous_variants`` and ``previous_prices``.

    Rows name their sweep in ``sweep``; with ``gap_seconds`` it is found from the page's fetches
    instead. Rows without a page or a sweep keep nulls and take no part. A null variant or price
    is none. Columns of ``rows`` with the names of the counts are replaced.
    """
    source = rows.drop(*COUNTS)
    if gap_seconds is not None:
        source = source.drop("sweep")
        whole = source.where("page_key is not null and observed_at is not null")
        times = sessions(source, gap_seconds)
        known = looked_up(times, times)
        counts = counted_sweeps(whole.join(known, ["page_key", "observed_at"]))
        # Sweep and counts are looked up at once, so that whole rows are shuffled for it once at most.
        facts = times.join(counts, ["page_key", "sweep"])
        done = whole.join(F.broadcast(facts) if known is not times else facts, ["page_key", "observed_at"])
        rest = source.where("page_key is null or observed_at is null").withColumn("sweep", F.lit(None).cast("long"))
    else:
        placed, rest = source.where("page_key is not null and sweep is not null"), source.where("page_key is null or sweep is null")
        done = placed.join(looked_up(counted_sweeps(placed), placed.select("page_key", "sweep").distinct()), ["page_key", "sweep"])
    return done.unionByName(rest.withColumns({c: F.lit(None).cast("long") for c in COUNTS}))
