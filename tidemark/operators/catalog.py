"""Catalogue upkeep: brands, products, variants, listings and offers as keyed merges over batches."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import brand_key, slugify
from .latest import array_overlap_join, keyed_merge, latest_by


def _new_or_kept(name: str) -> Column:
    return F.coalesce(F.col(f"b.{name}"), F.col(f"c.{name}"))


def _kept_or_new(name: str) -> Column:
    return F.coalesce(F.col(f"c.{name}"), F.col(f"b.{name}"))


def merge_brands(brands: DataFrame, names: DataFrame) -> DataFrame:
    """Brands (name_key, name) with those of ``names`` (name) that are new; a known name stays."""
    keyed = names.select(brand_key(F.col("name")).alias("name_key"), F.trim("name").alias("name")).where("name_key is not null")
    return keyed_merge(brands, latest_by(keyed, ["name_key"], [F.asc("name")]), ["name_key"], {"name": _kept_or_new("name")})


def _slugs_in_order(rows: pd.DataFrame) -> pd.DataFrame:
    """Slugs of one family of bases, product by product; rows without a product are taken slugs."""
    used = set(rows.loc[rows["product_id"].isna(), "base_"])
    following: dict[str, int] = {}
    found = []
    for product, base in rows[rows["product_id"].notna()].sort_values("product_id")[["product_id", "base_"]].itertuples(index=False):
        slug, n = base, following.get(base, 2)
        while slug in used:
            slug, n = f"{base}-{n}", n + 1
        following[base] = n
        used.add(slug)
        found.append((int(product), slug))
    return pd.DataFrame(found, columns=["product_id", "slug"])


def unique_slugs(products: DataFrame, taken: DataFrame) -> DataFrame:
    """Adds slug to products (product_id, name): the name's, with -2, -3, ... where an earlier product
    or ``taken`` (slug) has it. No two products share a slug.

    Only bases that differ in trailing numbers can meet (``Rod`` and ``Rod 2``). Most such families
    have one base and nothing taken: their numbers are a window's. The others are numbered in order,
    a family at a time.
    """
    root = lambda slug: F.regexp_replace(slug, r"(-\d+)+$", "")
    rows = products.withColumn("base_", slugify(F.col("name"))).withColumn("root_", root(F.col("base_")))
    mixed = rows.select("root_", "base_").union(taken.select(root(F.col("slug")), F.concat(F.lit("/"), "slug"))).groupBy("root_").agg((F.min("base_") != F.max("base_")).alias("mixed_"))
    rows = rows.join(mixed, "root_")
    place = F.row_number().over(Window.partitionBy("base_").orderBy("product_id"))
    plain = rows.where(~F.col("mixed_")).withColumn("slug", F.when(place == 1, F.col("base_")).otherwise(F.concat("base_", F.lit("-"), place.cast("string"))))
    known = taken.select(F.lit(None).cast("bigint").alias("product_id"), F.col("slug").alias("base_"), root(F.col("slug")).alias("root_"))
    asked = rows.where("mixed_").select(F.col("product_id").cast("bigint").alias("product_id"), "base_", "root_").unionByName(known)
    made = asked.groupBy("root_").applyInPandas(_slugs_in_order, "product_id bigint, slug string")
    numbered = rows.where("mixed_").join(made, "product_id")
    return plain.unionByName(numbered).drop("base_", "root_", "mixed_")


def merge_variants(variants: DataFrame, batch: DataFrame) -> DataFrame:
    """Variants by (product_id, variant_key): the label stays, GTINs are united in order."""
    one = batch.groupBy("product_id", "variant_key").agg(F.min("label").alias("label"), F.array_distinct(F.flatten(F.array_sort(F.collect_list("gtin14")))).alias("gtin14"))
    none = F.array().cast("array<string>")
    united = F.array_sort(F.array_distinct(F.concat(F.coalesce("c.gtin14", none), F.coalesce("b.gtin14", none))))
    return keyed_merge(variants, one, ["product_id", "variant_key"], {"label": _kept_or_new("label"), "gtin14": united})


def match_listings(listings: DataFrame, variants: DataFrame) -> DataFrame:
    """Variant and status of listings: one that shares a GTIN is matched, others are to be created.

    Merged variants (merged_into_id not null) match nothing. Several matches: the least variant.
    """
    live = variants.where("merged_into_id is null")
    hits = array_overlap_join(listings, live, "gtin14", "listing_id", "variant_id")
    return listings.select("listing_id").join(hits, "listing_id", "left").select(
        "listing_id", "variant_id", F.when(F.col("variant_id").isNotNull(), "auto_gtin").otherwise("auto_created").alias("match_status")
    )


def merge_sellers(sellers: DataFrame, batch: DataFrame) -> DataFrame:
    """Sellers by (retailer_id, seller_key); the type follows the batch."""
    return keyed_merge(sellers, batch, ["retailer_id", "seller_key"], {"name": _kept_or_new("name"), "seller_type": _new_or_kept("seller_type")})


def merge_listings(listings: DataFrame, batch: DataFrame) -> DataFrame:
    """Listings by (retailer_id, retailer_sku): parsed fields follow the batch; address, brand, the
    matched variant and its status stay; what is seen is active."""
    rules = {n: _new_or_kept(n) for n in ("title", "attributes", "gtin14", "unit_count")}
    rules |= {n: _kept_or_new(n) for n in ("url", "brand", "variant_id", "match_status")}
    rules["active"] = F.col("b.retailer_sku").isNotNull() | F.coalesce(F.col("c.active"), F.lit(False))
    return keyed_merge(listings, batch, ["retailer_id", "retailer_sku"], rules)


def merge_offers(offers: DataFrame, batch: DataFrame) -> DataFrame:
    """Offers by (listing_id, offer_key): the condition follows the batch, a seen offer is back."""
    seen = F.col("b.offer_key").isNotNull()
    rules = {"condition": _new_or_kept("condition"), "active": seen | F.coalesce(F.col("c.active"), F.lit(False)), "vanished_at": F.when(~seen, F.col("c.vanished_at"))}
    return keyed_merge(offers, batch, ["listing_id", "offer_key"], rules)


def grid_offers(rows: DataFrame) -> DataFrame:
    """One-offer listings of grid rows that are firm: a price, no range, and a claim to compare with.

    The SKU is the row's code or its link's last segment; clearance follows the page type.
    """
    firm = rows.where("price_cents is not null and not price_is_range and claimed_cents is not null")
    last = F.element_at(F.split(F.regexp_replace("product_url", "/+$", ""), "/"), -1)
    return firm.select(
        F.coalesce(F.nullif(F.col("product_code"), F.lit("")), last).alias("sku"), "title", "product_url", "price_cents", "claimed_cents",
        (F.col("page_type") == "CLEARANCE_LISTING").alias("on_clearance"), F.lit("IN_STOCK").alias("availability"),
    )


def fallback_variant_key(key: Column, retailer: Column, sku: Column) -> Column:
    return F.coalesce(key, F.concat(F.lit("raw:"), retailer, F.lit(":"), sku))


def find_barcodes(json_text: Column) -> Column:
    """Distinct 6 to 14 digit values of keys named gtin, barcode, upc or ean anywhere in a JSON text."""
    return F.array_distinct(F.regexp_extract_all(json_text, F.lit(r'(?i)"(?:gtin(?:8|12|13|14)?|barcode|upc|ean)"\s*:\s*"(\d{6,14})"'), F.lit(1)))
