"""Shop feeds in JSON to rows: discovered grid rows, listings and offers.

A body that does not have the expected envelope gives no rows; ``feed_outcome`` says why.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.gtin import normalize_all
from ..functions.money import dollars_to_cents
from ..functions.text import pack_count
from ..functions.web import safe_url

COLLECTION = "struct<products:array<struct<id:bigint,title:string,handle:string,vendor:string,variants:array<struct<id:bigint,title:string,sku:string,available:boolean,price:string,compare_at_price:string>>>>>"
PRODUCT = (
    "struct<id:bigint,title:string,handle:string,vendor:string,options:array<struct<name:string,position:int,values:array<string>>>,"
    "variants:array<struct<id:bigint,title:string,public_title:string,option1:string,option2:string,option3:string,sku:string,available:boolean,price:bigint,compare_at_price:bigint,barcode:string>>>"
)
SEARCH = "struct<results:array<struct<raw:struct<title:string,sku:string,offerprice:double,listprice:double,minofferprice:double,maxofferprice:double,producturlkeyword:string>>>>"
CATALOG = (
    "struct<productVOs:array<struct<name:string,partnumber:string,parentPartnumber:string,assetSeoUrl:string,"
    "dsgPriceIndicators:struct<priceIndicator:string,mapPriceIndicator:string>,floatFacets:array<struct<identifier:string,value:double>>>>>"
)


def feed_outcome(body: Column, envelope: Column) -> Column:
    """EMPTY for a blank body, STRUCTURE_CHANGED where the envelope's array is missing, else OK."""
    blank = F.coalesce(F.trim(body), F.lit("")) == ""
    return F.when(blank, "EMPTY").when(envelope.isNull(), "STRUCTURE_CHANGED").when(F.size(envelope) == 0, "EMPTY").otherwise("OK")


def _text_cents(price: Column) -> Column:
    return dollars_to_cents(price.try_cast("double"))


def collection_rows(pages: DataFrame) -> DataFrame:
    """One row per product of collection pages (url, host, body): the cheapest available variant,
    or the cheapest if none is; a claim only above the price; whether prices differ."""
    parsed = pages.select("url", "host", F.explode(F.from_json("body", COLLECTION)["products"]).alias("p"))
    ranked = F.array_sort(
        F.transform(
            F.filter("p.variants", lambda v: _text_cents(v["price"]).isNotNull()),
            lambda v: F.struct((~F.coalesce(v["available"], F.lit(False))).alias("away"), _text_cents(v["price"]).alias("cents"), v["id"].alias("id"), v["sku"].alias("sku"), _text_cents(v["compare_at_price"]).alias("claimed")),
        )
    )
    rows = parsed.withColumn("ranked", ranked).withColumn("best", F.get("ranked", F.lit(0)))
    return rows.select(
        "url",
        F.col("p.id").alias("product_code"),
        F.col("p.title").alias("title"),
        F.col("p.vendor").alias("brand"),
        F.concat(F.lit("https://"), F.col("host"), F.lit("/products/"), F.col("p.handle")).alias("product_url"),
        F.col("best.cents").alias("price_cents"),
        F.when(F.col("best.claimed") > F.col("best.cents"), F.col("best.claimed")).alias("claimed_cents"),
        (F.size(F.array_distinct(F.transform("ranked", lambda r: r["cents"]))) > 1).alias("price_is_range"),
        (~F.col("best.away")).alias("available"),
    )


def product_offers(pages: DataFrame) -> DataFrame:
    """One row per variant of product feeds (url, body): cents, claim, attributes by option name, GTINs, pack."""
    parsed = pages.select("url", F.from_json("body", PRODUCT).alias("p")).where("p.variants is not null")
    rows = parsed.select("url", "p", F.explode("p.variants").alias("v"))
    names = F.transform(F.array_sort(F.transform("p.options", lambda o: F.struct(o["position"].alias("k"), o["name"].alias("n")))), lambda o: F.lower(o["n"]))
    values = F.array("v.option1", "v.option2", "v.option3")
    pairs = F.filter(F.arrays_zip(names.alias("n"), values.alias("x")), lambda e: e["n"].isNotNull() & e["x"].isNotNull())
    return rows.select(
        "url",
        F.col("v.id").alias("variant_code"),
        F.coalesce(F.nullif(F.col("v.sku"), F.lit("")), F.col("v.id").cast("string")).alias("sku"),
        F.concat_ws(" - ", "p.title", F.coalesce("v.public_title", "v.title")).alias("title"),
        F.col("p.vendor").alias("brand"),
        F.when(F.col("v.price") > 0, F.col("v.price")).alias("price_cents"),
        F.when(F.col("v.compare_at_price") > F.col("v.price"), F.col("v.compare_at_price")).alias("claimed_cents"),
        F.when(F.col("v.available"), "IN_STOCK").otherwise("OUT_OF_STOCK").alias("availability"),
        F.map_from_entries(F.transform(pairs, lambda e: F.struct(e["n"], e["x"]))).alias("attributes"),
        normalize_all(F.array("v.barcode")).alias("gtin14"),
        F.coalesce(pack_count(F.coalesce("v.public_title", "v.title")), pack_count(F.col("p.title"))).alias("unit_count"),
    )


def search_rows(pages: DataFrame) -> DataFrame:
    """Rows of search results (url, body) in dollars; a range where the offers' least and largest differ."""
    r = F.col("r.raw")
    rows = pages.select("url", F.explode(F.from_json("body", SEARCH)["results"]).alias("r"))
    offer, listed = dollars_to_cents(r["offerprice"]), dollars_to_cents(r["listprice"])
    return rows.select(
        "url", r["sku"].alias("product_code"), r["title"].alias("title"), r["producturlkeyword"].alias("keyword"),
        offer.alias("price_cents"), F.when(listed > offer, listed).alias("claimed_cents"),
        F.coalesce(r["minofferprice"] != r["maxofferprice"], F.lit(False)).alias("price_is_range"),
    )


#: What the shop calls its own price facets, and where its pages are.
OFFER_FACET, LIST_FACET = "dickssportinggoodsofferprice", "dickssportinggoodslistprice"
CATALOG_ORIGIN, CATALOG_HOSTS = "https://www.dickssportinggoods.com", ("www.dickssportinggoods.com", "dickssportinggoods.com")


def catalog_rows(pages: DataFrame, offer_facet: str = OFFER_FACET, list_facet: str = LIST_FACET) -> DataFrame:
    """Rows of catalogue search (url, body): prices from the shop's own facets (of equal
    names the last), codes of the product
    family where there is one. Rows with a hidden price, without one or with a link to another host
    are left out."""
    rows = pages.select("url", F.explode(F.from_json("body", CATALOG)["productVOs"]).alias("p"))
    shown = F.coalesce(F.trim("p.dsgPriceIndicators.priceIndicator"), F.lit("")).isin("", "0", "false")

    def facet(name: str) -> Column:
        own = F.filter("p.floatFacets", lambda f: f["identifier"] == name)
        return dollars_to_cents(F.try_element_at(own, F.lit(-1))["value"])

    offer, listed = facet(offer_facet), facet(list_facet)
    link = F.when(F.col("p.assetSeoUrl").startswith("/"), F.concat(F.lit(CATALOG_ORIGIN), "p.assetSeoUrl")).otherwise(F.col("p.assetSeoUrl"))
    found = rows.where(shown).select(
        "url", F.coalesce(F.nullif(F.col("p.parentPartnumber"), F.lit("")), "p.partnumber").alias("product_code"), F.col("p.name").alias("title"),
        safe_url(link, F.lit(None).cast("string"), F.array(*[F.lit(h) for h in CATALOG_HOSTS])).alias("product_url"),
        offer.alias("price_cents"), F.when(listed > offer, listed).alias("claimed_cents"), F.when(listed > offer, "LIST").alias("claimed_kind"),
    )
    return found.where("price_cents is not null and product_url is not null")
