"""Offers of many shops in one schema."""

import json

import pytest

from tidemark.sources import registry

SCHEMA = "shop string, page_type string, url string, host string, body string"


def ld(product):
    return f"<script type='application/ld+json'>{json.dumps(product)}</script>"


@pytest.fixture(scope="module")
def pages(spark):
    card = '<div class="product-card-wrapper"><a class="product-card" href="/products/x"><h2 class="product-title"><span>Card</span></h2><div class="yotpo" data-product-id="42"></div><span class="current-price">$9.50</span></a></div>'
    used = '<div class="cattable-wrap-cell" data-code="U"><a class="cattable-wrap-cell-info" href="/u"></a><h3 class="cattable-wrap-cell-info-name">Used</h3><div class="cattable-wrap-cell-info-price">$20.00</div></div>'
    embedded = '<script id="ProductJson-1">' + json.dumps({"id": 1, "title": "T", "vendor": "V", "options": ["A"], "variants": [{"id": 2, "sku": "K", "title": "Red", "options": ["Red"], "price": 999, "available": True}]}) + "</script>"
    feed = json.dumps({"products": [{"id": 7, "title": "P", "vendor": "B", "handle": "h", "variants": [{"id": 8, "sku": "s", "price": "5.00", "compare_at_price": "9.00", "available": True}]}]})
    offers = [{"price": 12.5, "availability": "https://schema.org/InStock"}, {"price": 8, "itemCondition": "UsedCondition"}]
    rows = [
        ("jandh", "LISTING", "https://j/l", "j", card), ("tackle_warehouse", "USED_LISTING", "https://t/l", "t", used), ("jandh", "PRODUCT", "https://j/p", "j", embedded), ("penn", "LISTING", "https://p/l", "www.pennfishing.com", feed),
        ("academy", "PRODUCT", "https://a/p", "a", ld({"@type": "Product", "name": "N", "sku": "S", "offers": offers})), ("nobody", "PRODUCT", "https://n", "n", card), ("jandh", "ODD", "https://j/o", "j", card), ("fishusa", "PRODUCT", None, None, None),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def test_every_shop_gives_the_common_schema(spark, pages):
    made = registry.common_offers(pages)
    assert made.dtypes == list(registry.COMMON.items())
    got = sorted((r.shop, r.page_type, r.title, r.price_cents, r.claimed_cents, r.claimed_kind, r.condition, r.availability) for r in made.collect())
    assert got == [
        ("academy", "PRODUCT", "N", 800, None, None, "USED_UNGRADED", "UNKNOWN"), ("academy", "PRODUCT", "N", 1250, None, None, "NEW", "IN_STOCK"), ("jandh", "LISTING", "Card", 950, None, None, None, None),
        ("jandh", "PRODUCT", "T - Red", 999, None, None, "NEW", "IN_STOCK"), ("penn", "LISTING", "P", 500, 900, "WAS", None, "IN_STOCK"), ("tackle_warehouse", "USED_LISTING", "Used", 2000, None, None, "USED_UNGRADED", None),
    ]


def test_offers_in_sql(spark, pages):
    registry.common_offers(pages, ["academy", "jandh"]).createOrReplaceTempView("some_offers")
    assert [tuple(r) for r in spark.sql("select shop, count(*), min(price_cents) from some_offers group by shop order by shop").collect()] == [("academy", 2, 800), ("jandh", 2, 950)]
