"""Daily prices and the references that a discount is measured against.

Observations have offer_id, observed_at, observed_date, price_cents, shipping_cents, quality,
availability, on_clearance and a column ``seq`` that makes their order total.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import RULES
from ..functions.money import comparable_cents, landed_cents
from .latest import latest_by, ranked_by

def newest() -> list[Column]:
    return [F.desc("observed_at"), F.desc("seq")]


def offer_daily_price(observations: DataFrame) -> DataFrame:
    """The last OK observation of each offer and day."""
    last = latest_by(observations.where("quality = 'OK'"), ["offer_id", "observed_date"], newest())
    return last.select(
        "offer_id", "observed_date", "price_cents", landed_cents(F.col("price_cents"), F.col("shipping_cents")).alias("landed_cents"), "on_clearance", "availability"
    )


def offer_reference_stats(daily: DataFrame, as_of: Column | date, window_days: int = RULES.own_window_days) -> DataFrame:
    """Median, number of days, span and least price of each offer's days without clearance."""
    regular = ~F.col("on_clearance")
    recent = daily.where(F.col("observed_date") >= F.date_sub(as_of if isinstance(as_of, Column) else F.lit(as_of), window_days))
    day = F.when(regular, F.col("observed_date"))
    return recent.groupBy("offer_id").agg(
        F.percentile(F.when(regular, F.col("price_cents")), 0.5).alias("median_cents"),
        F.count_if(regular).alias("days"),
        F.datediff(F.max(day), F.min(day)).cast("bigint").alias("span_days"),
        F.min(F.when(regular, F.col("price_cents"))).alias("low_cents"),
        F.min("observed_date").alias("first_day"),
    )


def own_history_median(
    observations: DataFrame, as_of: Column | date, window_days: int = RULES.own_window_days, min_days: int = RULES.own_min_days, min_span: int = RULES.own_min_span
) -> DataFrame:
    """R1: rounded median of an offer's own regular daily prices, if there is enough evidence.

    Clearance rows are dropped before the last row of a day is taken.
    """
    start = F.date_sub(as_of if isinstance(as_of, Column) else F.lit(as_of), window_days)
    rows = observations.where("quality = 'OK' and not on_clearance").where(F.col("observed_date") >= start)
    last = latest_by(rows, ["offer_id", "observed_date"], newest())
    made = last.groupBy("offer_id").agg(
        F.bround(F.percentile("price_cents", 0.5), 0).cast("bigint").alias("reference_cents"),
        F.count("*").alias("days"),
        F.datediff(F.max("observed_date"), F.min("observed_date")).cast("bigint").alias("span_days"),
    )
    return made.where((F.col("days") >= min_days) & (F.col("span_days") >= min_span))


def latest_offer_state(observations: DataFrame, as_of: Column, max_age: str) -> DataFrame:
    """Each offer's latest OK, in-stock observation that is no older than ``max_age``."""
    rows = observations.where("quality = 'OK' and availability = 'IN_STOCK'").where(F.col("observed_at") >= as_of - F.expr(f"INTERVAL {max_age}"))
    return latest_by(rows, ["offer_id"], newest())


def cross_retailer_reference(own: DataFrame, others: DataFrame, conflicts: DataFrame | None = None) -> DataFrame:
    """R2: least latest price of the same variant and pack at another offer, one offer per retailer.

    ``own`` has offer_id, variant_id, unit_count. ``others`` are latest states with offer_id,
    variant_id, unit_count, retailer_id, listing_id, observed_at, seq, price_cents, of new,
    first-party offers. An unknown pack count matches nothing. ``conflicts`` (listing_id,
    variant_id) are left out. Ties go to the lowest retailer_id.
    """
    if conflicts is not None:
        others = others.join(conflicts, ["listing_id", "variant_id"], "left_anti")
    # The two latest offers of each retailer are enough: an offer is its own retailer's latest or not.
    group = ["variant_id", "unit_count"]
    rows = others.where("unit_count is not null").select(F.col("offer_id").alias("other_id"), *group, "retailer_id", "observed_at", "seq", "price_cents")
    two = ranked_by(rows, [*group, "retailer_id"], [F.desc("observed_at"), F.desc("seq"), F.asc("other_id")], 2)
    entry = F.struct("price_cents", "retailer_id", "other_id")
    best = two.where("rank_ = 1").groupBy(*group).agg(F.slice(F.array_sort(F.collect_list(entry)), 1, 2).alias("firsts"))
    spare = two.where("rank_ = 2").select(*group, "retailer_id", entry.alias("spare"))
    latest = two.where("rank_ = 1").select(F.col("other_id").alias("offer_id"), *group, "retailer_id")
    # Without an offer that is its retailer's latest, that retailer's next one counts.
    mine = own.select("offer_id", *group).join(best, group).join(latest, ["offer_id", *group], "left").join(spare, [*group, "retailer_id"], "left")
    other = F.get(F.filter("firsts", lambda x: x["other_id"] != F.col("offer_id")), F.lit(0))
    chosen = F.array_min(F.array_compact(F.array(other, F.col("spare"))))
    return mine.select("offer_id", chosen.alias("b")).where("b is not null").select("offer_id", F.col("b.price_cents").alias("reference_cents"), F.col("b.retailer_id").alias("retailer_id"))


def current_new_reference(own: DataFrame, others: DataFrame) -> DataFrame:
    """U1: least comparable price among the latest new offers of a variant, one per retailer."""
    o = others.select(
        "variant_id", "retailer_id", "observed_at", "seq", F.col("offer_id").alias("other_id"), comparable_cents(F.col("price_cents"), F.col("shipping_cents")).alias("cents")
    )
    each = latest_by(o, ["variant_id", "retailer_id"], [F.desc("observed_at"), F.desc("seq"), F.asc("other_id")])
    best = each.groupBy("variant_id").agg(F.min("cents").alias("reference_cents"))
    return own.select("offer_id", "variant_id").join(best, "variant_id").select("offer_id", "reference_cents")


def verified_reference(own: DataFrame, cross: DataFrame) -> DataFrame:
    """The lower of R1 and R2; R1 wins a tie."""
    r1 = own.select("offer_id", F.col("reference_cents").alias("own_cents"))
    r2 = cross.select("offer_id", F.col("reference_cents").alias("cross_cents"))
    both = r1.join(r2, "offer_id", "full_outer")
    first = F.col("own_cents").isNotNull() & (F.col("cross_cents").isNull() | (F.col("own_cents") <= F.col("cross_cents")))
    return both.select(
        "offer_id",
        F.least("own_cents", "cross_cents").alias("reference_cents"),
        F.when(first, "OWN_HISTORY_MEDIAN_90D").otherwise("CROSS_RETAILER_NEW").alias("reference_kind"),
    )


def claimed_inflated(claimed: Column, verified: Column, ratio: float = RULES.inflated_ratio) -> Column:
    """Whether a claimed price exceeds the verified one too far; null if either is missing."""
    return claimed > verified * F.lit(ratio)


def last_ok_before(observations: DataFrame) -> DataFrame:
    """Adds last_price: the price of the offer's last earlier OK row."""
    w = Window.partitionBy("offer_id").orderBy("observed_at", "seq").rowsBetween(Window.unboundedPreceding, -1)
    return observations.withColumn("last_price", F.last(F.when(F.col("quality") == "OK", F.col("price_cents")), ignorenulls=True).over(w))
