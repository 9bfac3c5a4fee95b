"""Export documents: deals feed, product documents, health, validation and the publishing gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import SHOWN_AVAILABILITY, SHOWN_CLAIM, SHOWN_REFERENCE, SHOWN_SELLER
from ..functions.basics import lookup
from ..functions.times import iso_z
from ..functions.web import host_of


def reference_label(kind: Column, lane: Column, days: Column) -> Column:
    shown = days.cast("string")
    return (
        F.when(kind == "OWN_HISTORY_MEDIAN_90D", F.when(days.isNotNull(), F.concat(F.lit("Median of its own prices over "), shown, F.lit(" days"))).otherwise(F.lit("Median of its own prices")))
        .when((kind == "CURRENT_NEW") | (lane == "USED"), F.lit("Lowest current new price"))
        .when(kind == "CROSS_RETAILER_NEW", F.lit("Lowest price at another shop"))
        .otherwise(F.lit("Reference price"))
    )


def deal_documents(deals: DataFrame) -> DataFrame:
    """Document rows of deals; the reference is left out where only the shop's claim is known."""
    claimed_only = F.col("reference_kind") == "RETAILER_CLAIMED"
    return deals.select(
        "deal_id",
        "lane",
        lookup(SHOWN_SELLER, F.col("seller_type")).alias("seller_type"),
        lookup(SHOWN_AVAILABILITY, F.col("availability"), F.lit("OUT_OF_STOCK")).alias("availability"),
        "price_cents",
        F.when(~claimed_only, F.col("reference_cents")).alias("reference_cents"),
        F.when(~claimed_only, lookup(SHOWN_REFERENCE, F.col("reference_kind"))).alias("reference_kind"),
        F.when(~claimed_only, reference_label(F.col("reference_kind"), F.col("lane"), F.col("reference_days"))).alias("reference_label"),
        F.col("claimed_cents"),
        F.when(F.col("claimed_cents").isNotNull(), lookup(SHOWN_CLAIM, F.col("claimed_kind"), F.lit("LIST"))).alias("claimed_kind"),
        "discount_bp",
        iso_z(F.col("detected_at")).alias("detected_at"),
        iso_z(F.coalesce("last_confirmed_at", "detected_at")).alias("last_confirmed_at"),
    )


def feed_violations(documents: DataFrame) -> DataFrame:
    """(deal_id, rule) for every document that breaks a schema or cross-field rule.

    Documents with ``retailer_url`` and ``hosts`` (the retailer's own) must have an https URL on one of them.
    The whole of a document's schema is checked by ``schemas.schema_violations``.
    """
    rules = {
        "lane_enum": F.col("lane").isin("VERIFIED", "CLAIMED", "USED"),
        "seller_enum": F.col("seller_type").isin("FIRST_PARTY", "MARKETPLACE"),
        "price_positive": F.col("price_cents") > 0,
        "discount_range": F.col("discount_bp").between(0, 10000),
        "claimed_without_reference": (F.col("lane") != "CLAIMED") | F.col("reference_cents").isNull(),
        "verified_with_reference": ~F.col("lane").isin("VERIFIED", "USED") | F.col("reference_cents").isNotNull(),
        "reference_above_price": F.col("reference_cents").isNull() | (F.col("reference_cents") > F.col("price_cents")),
    }
    if {"retailer_url", "hosts"} <= set(documents.columns):
        rules["url_allowed"] = F.col("retailer_url").startswith("https://") & F.array_contains("hosts", host_of(F.col("retailer_url")))
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(r, F.lit(False)), F.lit(n)) for n, r in rules.items()]))
    return documents.select("deal_id", F.explode(broken).alias("rule"))


def retailer_health(facts: DataFrame, now: Column, stale_hours: int = 12) -> DataFrame:
    """Health of retailers: breaker_open_until, last_success, blocked, fetched."""
    stale = F.col("last_success").isNull() | (F.col("last_success") < now - F.expr(f"INTERVAL {stale_hours} HOURS"))
    rate = F.when(F.col("fetched") > 0, F.col("blocked") / F.col("fetched")).otherwise(0.0)
    open_ = F.coalesce(F.col("breaker_open_until") > now, F.lit(False))
    status = F.when(open_, "FAILED").when(stale, "DEGRADED").when(rate > 0.20, "DEGRADED").otherwise("HEALTHY")
    return facts.select("retailer_id", status.alias("status"), (open_ | stale).alias("stale"), rate.alias("block_rate"))


def product_documents(products: DataFrame, offers: DataFrame, history: DataFrame) -> DataFrame:
    """One nested document per product: variants, each with its offers and price history."""
    o = offers.groupBy("variant_id").agg(F.array_sort(F.collect_list(F.struct("price_cents", "offer_id", "retailer_id", "availability"))).alias("offers"))
    h = history.groupBy("variant_id").agg(F.array_sort(F.collect_list(F.struct("observed_date", "retailer_id", "price_cents"))).alias("history"))
    v = products.join(o, "variant_id", "left").join(h, "variant_id", "left")
    none = lambda c, t: F.coalesce(F.col(c), F.array().cast(t))
    row = F.struct(
        "variant_id",
        none("offers", "array<struct<price_cents:bigint,offer_id:bigint,retailer_id:bigint,availability:string>>").alias("offers"),
        none("history", "array<struct<observed_date:date,retailer_id:bigint,price_cents:bigint>>").alias("history"),
    )
    return v.groupBy("product_id").agg(F.array_sort(F.collect_list(row)).alias("variants"))


def publishable(health: DataFrame, deals: int, force: bool = False) -> bool:
    """The gate: not an empty feed while every retailer is stale, unless forced."""
    all_stale = bool(health.agg(F.every("stale")).first()[0])
    return force or not (all_stale and deals == 0)


def meta_document(documents: DataFrame, health: DataFrame, now: Column, schema_version: int = 2) -> DataFrame:
    """The export's one-row head: counts by lane, shops, when it was made."""
    lane = F.col("lane")
    counts = documents.agg(*[F.count_if(lane == n).alias(n.lower()) for n in ("VERIFIED", "CLAIMED", "USED")], F.count("*").alias("deals"))
    shops = health.agg(F.count("*").alias("retailers"), F.count_if(F.col("status") != "HEALTHY").alias("unhealthy"))
    return counts.crossJoin(F.broadcast(shops)).select(F.lit(schema_version).alias("schema_version"), iso_z(now).alias("generated_at"), "*")  # one row each


def feed_filter(documents: DataFrame, category: str = "all", retailer: str = "all", condition: str = "all") -> DataFrame:
    """The client's filter; ``all`` lets everything pass, condition is ``new`` or ``used``."""
    keep = F.lit(True)
    if category != "all":
        keep &= F.col("category") == category
    if retailer != "all":
        keep &= F.col("retailer") == retailer
    if condition != "all":
        keep &= (F.col("condition") == "NEW") == F.lit(condition == "new")
    return documents.where(keep)


def feed_sort(documents: DataFrame, by: str = "discount_desc") -> list[Column]:
    """Sort order of a view: discount_desc, price_asc (landed price where known) or newest."""
    tail = [F.asc("deal_id")]
    orders = {"discount_desc": [F.desc("discount_bp")], "price_asc": [F.asc(F.coalesce("landed_cents", "price_cents"))], "newest": [F.desc("detected_at")]}
    return [*orders[by], *tail]
