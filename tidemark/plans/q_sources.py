"""Source parsers: feeds and pages are written from the test tables, then read back by the parsers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import feeds, markup, registry
from ..sources.files import dealt, table
from .registering import query


@query(
    """WITH v AS (SELECT p_partkey // 4 AS id, p_partkey AS vid, CAST(round(p_retailprice * 100) AS BIGINT) AS cents, p_size % 3 = 0 AS available, CASE WHEN p_size % 2 = 0 THEN CAST(round(p_retailprice * 100) AS BIGINT) * 2 END AS was FROM part),
    b AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY NOT available, cents, vid) AS rn, count(DISTINCT cents) OVER (PARTITION BY id) AS n FROM v)
    SELECT id AS product_code, cents AS price_cents, was AS claimed_cents, n > 1 AS price_is_range, available FROM b WHERE rn = 1"""
)
def collection_json_rows(spark, sf_dir):
    """A collection feed with a product for every four parts."""
    dollars = F.col("p_retailprice").cast("decimal(12,2)")
    variant = F.struct(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_partkey").cast("string").alias("sku"), (F.col("p_size") % 3 == 0).alias("available"),
        dollars.cast("string").alias("price"), F.when(F.col("p_size") % 2 == 0, (dollars * 2).cast("string")).alias("compare_at_price"),
    )
    products = table(spark, sf_dir, "part").groupBy(F.expr("p_partkey div 4").alias("id")).agg(F.first("p_name").alias("title"), F.min("p_brand").alias("vendor"), F.collect_list(variant).alias("variants"))
    product = F.struct("id", "title", F.concat(F.lit("h-"), F.col("id").cast("string")).alias("handle"), "vendor", "variants")
    pages = products.groupBy(F.expr("id div 30").alias("page")).agg(F.to_json(F.struct(F.collect_list(product).alias("products"))).alias("body"))
    rows = feeds.collection_rows(pages.select(F.col("page").cast("string").alias("url"), F.lit("shop.example.com").alias("host"), "body"))
    return rows.select("product_code", "price_cents", "claimed_cents", "price_is_range", "available")


@query(
    """SELECT 'S' || p_partkey AS sku, p_name AS title, p_brand AS brand, CAST(round(p_retailprice * 100) AS BIGINT) AS price_cents,
    CASE p_size % 3 WHEN 0 THEN 'IN_STOCK' WHEN 1 THEN 'OUT_OF_STOCK' ELSE 'UNKNOWN' END AS availability, 'NEW' AS condition FROM part
    UNION ALL SELECT 'S' || p_partkey, p_name, p_brand, 500 + p_size, 'STORE_ONLY', 'USED_UNGRADED' FROM part WHERE p_partkey % 2 = 0"""
)
def jsonld_products(spark, sf_dir):
    """Product pages with JSON-LD, one per part; every other one has its offers in a list, a used one among them."""
    stock = F.when(F.col("p_size") % 3 == 0, "https://schema.org/InStock").when(F.col("p_size") % 3 == 1, "https://schema.org/OutOfStock").otherwise("https://schema.org/Rumour")
    item = F.struct(
        F.lit("Product").alias("@type"), F.concat(F.lit("S"), F.col("p_partkey").cast("string")).alias("sku"), F.col("p_name").alias("name"), F.struct(F.col("p_brand").alias("name")).alias("brand"),
        F.struct(F.col("p_retailprice").cast("decimal(12,2)").cast("string").alias("price"), stock.alias("availability")).alias("offers"),
    )
    second = F.format_string('},{"price":5.%02d,"availability":"https://schema.org/instoreonly","itemCondition":"https://schema.org/UsedCondition"}]}', F.col("p_size"))
    text = F.to_json(item)
    text = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.regexp_replace(F.regexp_replace(text, r'"offers":\{', '"offers":[{'), r"\}\}$", ""), second)).otherwise(text)
    body = F.concat(F.lit('<html><script>var a=1</script><script type="application/ld+json">{broken</script><script type="application/ld+json">'), text, F.lit("</script></html>"))
    pages = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("url"), body.alias("body"))
    return markup.json_ld_offers(pages).select("sku", "title", "brand", "price_cents", "availability", "condition")


def _text(column) -> object:
    return F.lit(column) if isinstance(column, str) else column.cast("string")


def _pages(cells, per_page: int = 50):
    """Pages (url, body) of a shop from cells (k, cell)."""
    paged = cells.groupBy((F.col("k") / per_page).cast("bigint").alias("page")).agg(F.array_join(F.collect_list("cell"), "\n").alias("cells"))
    return paged.select(F.concat(F.lit("https://shop.example/list?page="), F.col("page").cast("string")).alias("url"), F.concat(F.lit("<!DOCTYPE html><html><body><div>$1.00</div>"), "cells", F.lit("</body></html>")).alias("body"))


def _html(*parts):
    return F.concat(*[_text(p) for p in parts])


def _orders(spark, sf_dir, cell):
    return _pages(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), cell.alias("cell")))


@query(
    """SELECT CAST(o_orderkey AS VARCHAR) AS product_code, 'Rod ' || o_orderkey AS title, 'https://shop.example/descpage-' || o_orderkey || '.html' AS product_url,
    o_custkey * 100 + 99 AS price_cents, CASE WHEN o_orderkey % 3 > 0 THEN (o_custkey + 50) * 100 END AS claimed_cents,
    CASE o_orderkey % 3 WHEN 1 THEN 'MSRP' WHEN 2 THEN 'WAS' END AS claimed_kind FROM orders"""
)
def html_grid_rows(spark, sf_dir):
    """Catalogue cells: the former price stands inside the price, a star behind it makes it an MSRP."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    was = F.when(k % 3 > 0, _html('<span class="is-crossout">$', c + 50, ".00</span>", F.when(k % 3 == 1, "*").otherwise(""))).otherwise("")
    cell = _html(
        '<div class="cattable-wrap-cell gtm_impression" data-code="', k, '"><a class="cattable-wrap-cell-info" href="https://shop.example/descpage-', k, '.html%0D"><div class="cattable-wrap-cell-info-flag sale">Clearance -5%</div>',
        '<h3 class="cattable-wrap-cell-info-name">Rod <b>', k, '</b></h3><div class="cattable-wrap-cell-info-price is-sale">\n$<span>', c, '.99</span><span class="cattable-wrap-cell-info-price-msrp">', was, "</span>\n</div></a></div>",
    )
    return markup.grid_rows(_orders(spark, sf_dir, cell), "catalogue_cells").select("product_code", "title", "product_url", "price_cents", "claimed_cents", "claimed_kind")


@query(
    """SELECT 'p' || o_orderkey AS product_code, 'Reel ' || o_orderkey AS title, 'https://shop.example/p/' || o_orderkey AS product_url, o_custkey * 100 + 92 AS price_cents,
    CASE WHEN o_orderkey % 3 > 0 THEN (o_custkey + 20) * 100 + 99 END AS claimed_cents, CASE WHEN o_orderkey % 3 > 0 THEN 'WAS' END AS claimed_kind, o_orderkey % 2 = 0 AS price_is_range FROM orders"""
)
def range_grid_rows(spark, sf_dir):
    """Items whose prices may be ranges: the least of each range counts, for price and claim."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    price = _html("$", c, ".92", F.when(k % 2 == 0, _html(" - $", c + 9, ".99")).otherwise(""))
    before = F.when(k % 3 == 1, _html('<span class="price-strikethrough">$', c + 20, ".99 - $", c + 40, ".99</span>")).when(k % 3 == 2, _html('$<span class="price-strikethrough">', c + 20, ".99</span>")).otherwise("")
    cell = _html(
        '<div class="product-item js-product-item" data-product-code="p', k, '"><a class="thumb" href="/t/', k, '"></a><h2 class="details"><a class="name" href="/p/', k, '">Reel ', k, '</a></h2>',
        '<div class="smw-sale-price displayed-price"><span class="sr-only">Sale price:</span>\n', price, '<span class="price-before price-del currency"><span class="sr-only">Original price:</span>', before, "</span></div></div>",
    )
    return markup.grid_rows(_orders(spark, sf_dir, cell), "product_items").select("product_code", "title", "product_url", "price_cents", "claimed_cents", "claimed_kind", "price_is_range")


@query(
    """SELECT CAST(o_orderkey AS VARCHAR) AS product_code, 'Tile ' || o_orderkey AS title, o_custkey * 100 + 99 AS price_cents,
    (o_custkey + 30 * (o_orderkey % 3)) * 100 AS claimed_cents FROM orders WHERE o_orderkey % 4 IN (0, 1) AND o_orderkey % 5 > 0 AND (o_custkey + 30 * (o_orderkey % 3)) * 100 > o_custkey * 100 + 99"""
)
def badge_grid_rows(spark, sf_dir):
    """Tiles with a badge: only those on clearance or on sale whose former price is above the present one; the member's price is neither."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    badge = F.element_at(F.array(*[F.lit(x) for x in ("Clearance", " On Sale ", "Members Only Deal", "Members Only Save 25%")]), (k % 4 + 1).cast("int"))
    was = F.when(k % 5 > 0, _html('<span class="was-price"><span class="price-label">Was</span><span class="price strike">$', c + 30 * (k % 3), ".00</span></span>")).otherwise("")
    cell = _html(
        '<div class="product-tile" role="group"><div class="image-banner blue">', badge, '</div><a class="anchor-container" href="/product/', k, '" pid="', k, '"><div class="product-name"><span>Tile ', k, "</span></div>",
        '<span class="regular-price">\n$', c, '.99 <span class="slash"> /</span></span><span class="club-price">$0.99 <span class="member-span">Club</span></span>', was, "</a></div>",
    )
    return markup.grid_rows(_orders(spark, sf_dir, cell), "badge_tiles").select("product_code", "title", "price_cents", "claimed_cents")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS product_code, 'Card ' || o_orderkey AS title, 'https://shop.example/products/' || o_orderkey AS product_url, (o_custkey + 1) * 100 AS price_cents, o_orderkey % 2 = 1 AS price_is_range FROM orders")
def card_grid_rows(spark, sf_dir):
    """Product cards: a price after ``From`` is the least of a range, and no card makes a claim."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    cell = _html(
        '<div class="product-card-wrapper" data-vendor="v"><a class="product-card" href="/products/', k, '"><img src="i.jpg"><h2 class="product-title">\n<span>Card ', k, '</span></h2><div class="yotpo bottomLine" data-product-id="', k, '"></div>',
        F.when(k % 2 == 1, '<span class="fromtag">From<br></span>').otherwise(""), '<div class="product-price"><span class="current-price ">\n$', c + 1, ".00\n</span></div></a></div>",
    )
    return markup.grid_rows(_orders(spark, sf_dir, cell), "product_cards").select("product_code", "title", "product_url", "price_cents", "price_is_range")


STOCK_WORDS = ("0", "3", "10+", "9/15", "14 Days", "soon")
STOCK_SQL = """CASE p_size % 6 WHEN 1 THEN 3 WHEN 2 THEN 10 WHEN 0 THEN 0 END AS quantity, p_size % 6 = 2 AS quantity_is_floor,
    CASE p_size % 6 WHEN 0 THEN 'OUT_OF_STOCK' WHEN 1 THEN 'IN_STOCK' WHEN 2 THEN 'IN_STOCK' WHEN 5 THEN 'UNKNOWN' ELSE 'BACKORDER' END AS availability"""


def _parts(spark, sf_dir, body):
    rows = dealt(table(spark, sf_dir, "part"))
    return rows.select(F.concat(F.lit("https://shop.example/"), F.col("p_partkey").cast("string")).alias("url"), body.alias("body"))


def _dollars():
    return F.col("p_retailprice").cast("decimal(12,2)").cast("string")


@query(
    f"""SELECT 'S' || p_partkey AS sku, 'G' || p_partkey AS product_code, p_name AS title, p_brand AS brand, CAST(round(p_retailprice * 100) AS BIGINT) AS price_cents, {STOCK_SQL},
    p_type AS rod_type, CAST(p_size AS VARCHAR) AS rod_length FROM part"""
)
def ordering_row_offers(spark, sf_dir):
    """Product pages with an ordering row for a variant: stock cells, properties, brand of the page."""
    k = F.col("p_partkey")
    stock = F.element_at(F.array(*[F.lit(w) for w in STOCK_WORDS]), (F.col("p_size") % 6 + 1).cast("int"))
    style = lambda name, value: _html('<li class="js-ordering-style" data-styleref="1"><strong class="js-ordering-style-name style">', name, '</strong>:\n<span class="js-ordering-style-item-name styleitem">', value, "</span></li>")
    body = _html(
        '<html><body><meta itemprop="brand" content="', F.col("p_brand"), '"><h1>', F.col("p_name"), '</h1><div class="desc_top" data-gtm_detail_id="G', k, '"></div><table><tr class="js-ordering-subproduct subproduct cf" itemprop="offers" data-code="S', k,
        '"><td><strong class="js-ordering-name name">Variant</strong><div class="fl stock"><strong>In Stock:</strong><span class="js-ordering-available available">', stock,
        '</span></div><div class="fr"><strong>Price:</strong>$<span class="js-ordering-price price">', _dollars(), '</span></div><ul class="js-ordering-stylelist">', style("Type", F.col("p_type")), style("Length", F.col("p_size")),
        '</ul><meta itemprop="price" content="1.00"></td></tr></table></body></html>',
    )
    made = markup.spec_offers(_parts(spark, sf_dir, body), "ordering_rows")
    return made.select("sku", "product_code", "title", "brand", "price_cents", "quantity", "quantity_is_floor", "availability", F.col("attributes")["Type"].alias("rod_type"), F.col("attributes")["Length"].alias("rod_length"))


@query(
    """SELECT CAST(p_partkey AS VARCHAR) AS sku, 'P' || p_partkey AS product_code, p_name AS title, p_brand AS brand, 'M' || p_size AS variant_label, CAST(round(p_retailprice * 100) AS BIGINT) AS price_cents,
    p_size % 4 AS quantity, CASE WHEN p_size % 4 = 0 THEN 'OUT_OF_STOCK' ELSE 'IN_STOCK' END AS availability, p_type AS power FROM part"""
)
def spec_card_offers(spark, sf_dir):
    """Variant cards whose properties are a table of one row each; the wide table beside it is not read."""
    k = F.col("p_partkey")
    line = lambda name, value: _html('<tr class="rod-spec"><td class="rod-spec-title-mobile">', name, '</td>\n\n<td class="rod-spec-value-mobile">', value, '</td></tr><p style="display:none">1</p>')
    body = _html(
        "<h1>", F.col("p_name"), '</h1><div class="productView-brand h6">\n<a href="/b/"><span>', F.col("p_brand"), '</span></a></div><div class="variant-container single-variant" data-product-id="P', k,
        '" data-color-id="5"><table class="rod-spec-table"><tr><td class="rod-spec-title">Model</td><td class="rod-spec-title">Power</td></tr><tr><td class="rod-spec-value">x</td><td class="rod-spec-value">y</td></tr></table>',
        '<table class="rod-spec-table-mobile">', line("Model", _html("M", F.col("p_size"))), line("Power", F.col("p_type")), '</table><div class="rod-stock-message"><span class="selected" data-inventory="', F.col("p_size") % 4,
        '"></span></div><input class="form-input" value="1"><div class="rod-sku">\n#', k, '\n</div><div class="rod-price-container"><span class="h4 regular-price-tag">$', _dollars(), "</span></div></div>",
    )
    made = markup.spec_offers(_parts(spark, sf_dir, body))
    return made.select("sku", "product_code", "title", "brand", "variant_label", "price_cents", "quantity", "availability", F.col("attributes")["Power"].alias("power"))


@query(
    """SELECT 'S' || p_partkey AS sku, p_name || ' - Red' AS title, p_brand AS brand, CAST(round(p_retailprice * 100) AS BIGINT) AS price_cents, CASE WHEN p_size % 2 = 0 THEN 'IN_STOCK' ELSE 'OUT_OF_STOCK' END AS availability,
    'Red' AS color, CASE p_size % 3 WHEN 0 THEN '00780647104070' WHEN 1 THEN '00810057871436' END AS gtin FROM part"""
)
def embedded_product_rows(spark, sf_dir):
    """Pages with their product as JSON: barcodes of the variants, else of the page's JSON-LD by sku."""
    sku, kind = _html("S", F.col("p_partkey")), F.col("p_size") % 3
    variant = F.struct(
        F.col("p_partkey").alias("id"), sku.alias("sku"), F.lit("Red").alias("title"), F.array(F.lit("Red")).alias("options"), F.round(F.col("p_retailprice") * 100).cast("bigint").alias("price"), F.lit(10**9).alias("compare_at_price"),
        (F.col("p_size") % 2 == 0).alias("available"), F.when(kind == 0, "780647104070").alias("barcode"),
    )
    product = F.to_json(F.struct(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_brand").alias("vendor"), F.array(F.lit("Color")).alias("options"), F.array(variant).alias("variants")))
    listed = F.array(*[F.struct(s.alias("identifier"), F.struct(F.lit("Barcode").alias("name"), F.lit(c).alias("value")).alias("valueReference")) for s, c in ((F.lit("other"), "036000291452"), (F.when(kind == 1, sku), "810057871436"))])
    body = _html('<script type="application/ld+json">{"@type":"BreadcrumbList"}</script><script type="application/ld+json">', F.to_json(F.struct(F.lit("Product").alias("@type"), listed.alias("additionalProperty"))), '</script><script id="ProductJson-1" type="application/json">', product, "</script>")
    made = markup.embedded_product_offers(_parts(spark, sf_dir, body))
    return made.select("sku", "title", "brand", "price_cents", "availability", F.col("attributes")["Color"].alias("color"), F.get("gtin14", F.lit(0)).alias("gtin"))


@query(
    """SELECT CASE WHEN p_size % 2 = 0 THEN 'F' || p_partkey ELSE 'N' || p_partkey END AS product_code, p_name AS title, 'https://www.dickssportinggoods.com/p/' || p_partkey AS product_url, CAST(round(p_retailprice * 100) AS BIGINT) AS price_cents,
    CASE WHEN p_size % 3 = 0 THEN CAST(round(p_retailprice * 100) AS BIGINT) * 2 END AS claimed_cents FROM part WHERE p_size % 5 NOT IN (0, 1, 2)"""
)
def catalog_search_rows(spark, sf_dir):
    """Catalogue search: hidden prices (0 mod 5), rows without a price of their own (1) and foreign links (2) are left out."""
    k, m = F.col("p_partkey"), F.col("p_size") % 5
    facet = lambda name, value: F.struct(name.alias("identifier") if not isinstance(name, str) else F.lit(name).alias("identifier"), value.cast("double").alias("value"))
    own = F.when(m == 1, "someoneelseofferprice").otherwise("dickssportinggoodsofferprice")
    product = F.struct(
        F.col("p_name").alias("name"), _html("N", k).alias("partnumber"), F.when(F.col("p_size") % 2 == 0, _html("F", k)).alias("parentPartnumber"), F.when(m == 2, _html("https://elsewhere.example/p/", k)).otherwise(_html("/p/", k)).alias("assetSeoUrl"),
        F.struct(F.when(m == 0, 1).otherwise(0).alias("priceIndicator"), F.lit(1).alias("mapPriceIndicator")).alias("dsgPriceIndicators"),
        F.array(facet("someoneelseofferprice", F.lit(1)), facet(own, F.col("p_retailprice")), facet("dickssportinggoodslistprice", F.when(F.col("p_size") % 3 == 0, F.round(F.col("p_retailprice") * 100) * 2 / 100).otherwise(F.col("p_retailprice")))).alias("floatFacets"),
    )
    made = table(spark, sf_dir, "part").groupBy((k / 40).cast("bigint").alias("page")).agg(F.to_json(F.struct(F.collect_list(product).alias("productVOs"))).alias("body"))
    return feeds.catalog_rows(made.select(F.col("page").cast("string").alias("url"), "body")).select("product_code", "title", "product_url", "price_cents", "claimed_cents")


@query(
    """SELECT CAST(p_partkey AS VARCHAR) AS product_code, CAST(round(p_retailprice * 100) AS BIGINT) AS price_cents,
    CASE WHEN p_size % 3 = 0 THEN CAST(round(p_retailprice * 100) AS BIGINT) * 2 WHEN p_size % 3 = 1 THEN CAST(round(p_retailprice * 100) AS BIGINT) * 3 END AS claimed_cents,
    CASE WHEN p_size % 3 = 0 THEN 'MSRP' WHEN p_size % 3 = 1 THEN 'WAS' END AS claimed_kind, CASE WHEN p_size % 2 = 0 THEN 'IN_STOCK' ELSE 'OUT_OF_STOCK' END AS availability FROM part"""
)
def meta_page_facts(spark, sf_dir):
    money = lambda n: (F.col("p_retailprice").cast("decimal(12,2)") * n).cast("decimal(12,2)").cast("string")
    kind = F.col("p_size") % 3
    body = F.concat(
        F.lit('<meta property="og:availability" content="'), F.when(F.col("p_size") % 2 == 0, "instock").otherwise("OOS"), F.lit('"><input name="product_id" value="'), F.col("p_partkey").cast("string"),
        F.lit('"><span data-product-price-without-tax class="price price--withoutTax">$'), money(1), F.lit("</span>"),
        F.when(kind == 0, F.concat(F.lit('<span data-product-rrp-price-without-tax class="price price--rrp"> $'), money(2), F.lit("</span>"))).otherwise(""),
        F.when(kind <= 1, F.concat(F.lit('<span data-product-non-sale-price-without-tax class="price price--non-sale">$'), money(3), F.lit("</span>"))).otherwise(""),
    )
    pages = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("url"), body.alias("body"))
    return markup.meta_page(pages).select("product_code", "price_cents", "claimed_cents", "claimed_kind", "availability")


@query(
    """SELECT 'academy' AS shop, 'PRODUCT' AS page_type, 'S' || p_partkey AS sku, NULL AS product_code, p_name AS title, CAST(round(p_retailprice * 100) AS BIGINT) AS price_cents, NULL::BIGINT AS claimed_cents, NULL AS claimed_kind, 'NEW' AS condition, 'IN_STOCK' AS availability FROM part WHERE p_partkey % 3 = 0
    UNION ALL SELECT 'jandh', 'LISTING', NULL, CAST(p_partkey AS VARCHAR), 'Card ' || p_partkey, (p_size + 1) * 100, NULL, NULL, NULL, NULL FROM part WHERE p_partkey % 3 = 1
    UNION ALL SELECT 'penn', 'LISTING', NULL, CAST(p_partkey AS VARCHAR), p_name, 500, CASE WHEN p_size > 5 THEN p_size * 100 END, CASE WHEN p_size > 5 THEN 'WAS' END, NULL, 'IN_STOCK' FROM part WHERE p_partkey % 3 = 2"""
)
def shop_offers(spark, sf_dir):
    """Pages of three kinds of shops in one table, read into the common columns."""
    k, kind = F.col("p_partkey"), F.col("p_partkey") % 3
    offer = F.array(F.struct(F.round("p_retailprice", 2).alias("price"), F.lit("https://schema.org/InStock").alias("availability")))
    product = F.concat(F.lit('<script type="application/ld+json">'), F.to_json(F.struct(F.lit("Product").alias("@type"), F.concat(F.lit("S"), k.cast("string")).alias("sku"), F.col("p_name").alias("name"), offer.alias("offers"))), F.lit("</script>"))
    card = _html('<div class="product-card-wrapper"><a class="product-card" href="/p/', k, '"><h2 class="product-title"><span>Card ', k, '</span></h2><div class="yotpo" data-product-id="', k, '"></div><span class="current-price">$', F.col("p_size") + 1, ".00</span></a></div>")
    variant = F.struct(k.alias("id"), F.lit("5.00").alias("price"), F.format_string("%d.00", "p_size").alias("compare_at_price"), F.lit(True).alias("available"))
    feed = F.to_json(F.struct(F.array(F.struct(k.alias("id"), F.col("p_name").alias("title"), F.lit("h").alias("handle"), F.array(variant).alias("variants"))).alias("products")))
    shop = F.when(kind == 0, "academy").when(kind == 1, "jandh").otherwise("penn")
    pages = table(spark, sf_dir, "part").select(
        shop.alias("shop"), F.when(kind == 0, "PRODUCT").otherwise("LISTING").alias("page_type"), F.concat(F.lit("https://x.example/"), k.cast("string")).alias("url"), F.lit("x.example").alias("host"), F.when(kind == 0, product).when(kind == 1, card).otherwise(feed).alias("body"),
    )
    made = registry.common_offers(pages, ("academy", "jandh", "penn"))
    return made.select("shop", "page_type", "sku", "product_code", "title", "price_cents", "claimed_cents", "claimed_kind", "condition", "availability")
