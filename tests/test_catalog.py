"""Catalogue merges, parser registry and file helpers."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import catalog
from tidemark.plans.catalogue import QUERIES
from tidemark.sources import files, markup, registry


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=str)


def test_brands_and_slugs(spark):
    known = spark.createDataFrame([("st_croix", "St. Croix")], "name_key string, name string")
    names = spark.createDataFrame([("ST CROIX",), (" Penn ",), ("",), (None,)], "name string")
    assert rows(catalog.merge_brands(known, names), "name_key", "name") == [("penn", "Penn"), ("st_croix", "St. Croix")]
    products = spark.createDataFrame([(1, "Rod A"), (2, "rod a"), (3, "Reel")], "product_id int, name string")
    taken = spark.createDataFrame([("reel",)], "slug string")
    assert rows(catalog.unique_slugs(products, taken), "product_id", "slug") == [(1, "rod-a"), (2, "rod-a-2"), (3, "reel-2")]


def test_variants_listings_offers(spark):
    v = "product_id int, variant_key string, label string, gtin14 array<string>"
    merged = catalog.merge_variants(spark.createDataFrame([(1, "k", "old", ["b"])], v), spark.createDataFrame([(1, "k", "new", ["a", "b"]), (1, "k", "newer", ["c"]), (2, "m", "x", None)], v))
    assert rows(merged, "product_id", "label", "gtin14") == [(1, "old", ["a", "b", "c"]), (2, "x", [])]
    l = "retailer_id int, retailer_sku string, title string, attributes map<string,string>, gtin14 array<string>, unit_count int, url string, brand string, variant_id int, match_status string, active boolean"  # noqa: E741
    current = spark.createDataFrame([(1, "s", "old", None, None, None, "u1", "b1", 7, "manual", False)], l)
    batch = spark.createDataFrame([(1, "s", "new", None, None, 3, "u2", "b2", 9, "auto_gtin", None), (1, "t", "t", None, None, None, "u3", None, None, "auto_created", None)], l)
    assert rows(catalog.merge_listings(current, batch), "retailer_sku", "title", "unit_count", "url", "variant_id", "match_status", "active") == [("s", "new", 3, "u1", 7, "manual", True), ("t", "t", None, "u3", None, "auto_created", True)]
    o = "listing_id int, offer_key string, condition string, active boolean, vanished_at timestamp"
    gone = spark.sql("select 1 as listing_id, 'k' as offer_key, 'NEW' as condition, false as active, timestamp'2024-01-01' as vanished_at")
    assert rows(catalog.merge_offers(gone, spark.createDataFrame([(1, "k", "USED_GOOD", None, None)], o)), "condition", "active", "vanished_at") == [("USED_GOOD", True, None)]
    s = "retailer_id int, seller_key string, name string, seller_type string"
    assert rows(catalog.merge_sellers(spark.createDataFrame([(1, "a", "A", "X")], s), spark.createDataFrame([(1, "a", "B", "Y")], s)), "name", "seller_type") == [("A", "Y")]


def test_registry_and_table_function(spark):
    assert len(registry.PARSERS) == 23 and registry.collection_url("penn").endswith("/collections/sale/products.json")
    with pytest.raises(KeyError):
        registry.parser_of("nobody", "LISTING")
    registry.register_table_functions(spark)
    body = '<div class="product-item js-product-item" data-product-code="9"><div class="smw-sale-price displayed-price">$5</div></div>'
    got = spark.sql(f"select ord, cell['price'] as p, cell['cell_data-product-code'] as c from grid_cells('{body}', 'product_items')").first()
    assert tuple(got) == (0, "$5", "9")
    page = spark.createDataFrame([("u", body)], "url string, body string")
    assert registry.parser_of("sportsmans_warehouse", "LISTING")(page).first().price_cents == 500


def test_spec_cards_ordering_rows_and_embedded_products(spark):
    def first(parse, body, *family):
        return parse(spark.createDataFrame([("https://h/p", body)], "url string, body string"), *family).first()

    card = """<h1>Some Rod</h1><div class="productView-brand h6"><a href="/b"><span>Maker</span></a></div>
    <div class="variant-container single-variant" data-product-id="77" data-color-id="1"><table class="rod-spec-table"><tr><td class="rod-spec-title">Model</td><td class="rod-spec-title">Length</td></tr>
    <tr><td class="rod-spec-value">M1</td><td class="rod-spec-value">7'</td></tr></table><table class="rod-spec-table-mobile"><tr class="rod-spec"><td class="rod-spec-title-mobile">Model</td> <td class="rod-spec-value-mobile">M1</td></tr>
    <p style="display:none"> 1 </p><tr class="rod-spec"><td class="rod-spec-title-mobile">Length</td><td class="rod-spec-value-mobile">7' 6"</td></tr></table>
    <div class="rod-stock-message"><span class="selected" data-inventory="4"></span></div><input class="form-input" value="1"><div class="rod-sku"> #4711 </div><div class="price-container"><span class="h4 regular-price-tag">$9.50</span></div></div>"""
    r = first(markup.spec_offers, card)
    assert (r.product_code, r.sku, r.price_cents, r.claimed_cents, r.quantity, r.availability, r.attributes) == ("77", "4711", 950, None, 4, "IN_STOCK", {"Model": "M1", "Length": "7' 6\""})
    assert (r.title, r.brand, r.variant_label) == ("Some Rod", "Maker", "M1")
    line = """<meta itemprop="brand" content="St. X"><h1>Rods</h1><div class="desc_top" data-gtm_detail_id="DD"></div><table><tr class="js-ordering-subproduct subproduct cf" data-code="D1"><td>
    <strong class="js-ordering-name name">Rod 7'</strong><strong>In Stock:</strong><span class="js-ordering-available available">10+</span><strong>Price:</strong>$<span class="js-ordering-price price">130.00</span>
    <ul><li class="js-ordering-style"><strong class="js-ordering-style-name style">Length</strong>: <span class="js-ordering-style-item-name styleitem">7'6"</span></li></ul>
    <meta itemprop="price" content="130.00"><meta itemprop="gtin13" content="0780647104070"></td></tr></table>"""
    r = first(markup.spec_offers, line, "ordering_rows")
    assert (r.product_code, r.sku, r.brand, r.price_cents, r.quantity, r.quantity_is_floor, r.availability, r.gtin14) == ("DD", "D1", "St. X", 13000, 10, True, "IN_STOCK", ["00780647104070"])
    assert r.attributes == {"Length": "7'6\""}
    body = (
        '<script id="ProductJson-1" type="application/json">{"id":1,"title":"T","vendor":"V","options":["A"],"variants":[{"id":2,"sku":"K","title":"Red","options":["Red"],"price":999,"compare_at_price":1999,"available":true,"barcode":"780647104070"},'
        '{"id":3,"sku":"L","title":"Blue","options":["Blue"],"price":0,"available":false}]}</script>'
        '<script type="application/ld+json">{"@type":"Product","additionalProperty":[{"name":"x","identifier":"L","valueReference":{"name":"Barcode","value":"810057871436"}}]}</script>'
    )
    got = rows(markup.embedded_product_offers(spark.createDataFrame([("u", body)], "url string, body string")), "sku", "title", "price_cents", "claimed_cents", "availability", "gtin14")
    assert got == [("K", "T - Red", 999, None, "IN_STOCK", ["00780647104070"]), ("L", "T - Blue", None, None, "OUT_OF_STOCK", ["00810057871436"])]


def test_browser_capture(spark):
    body = '<script type="application/ld+json">{"@type":"Product","name":"N","offers":{"price":"12.50","itemCondition":"https://schema.org/UsedCondition"}}</script><s>was $30.00</s>'
    pages = spark.createDataFrame([("https://h/p", "h", body), ("https://h/q", "h", "nothing")], "url string, host string, body string")
    r = markup.browser_capture(pages, {"h": r"<s>was ([^<]*)</s>"}).collect()
    assert [tuple(x) for x in r] == [("https://h/p", "N", "USED_UNGRADED", "USD", 1250, 3000)]


def test_file_helpers(spark, tmp_path):
    assert files.sink_root({}) == "exports" and files.sink_root({"EXPORT_TARGET": "s3", "EXPORT_BUCKET": "b", "EXPORT_PREFIX": "p/"}) == "s3a://b/p"
    with pytest.raises(ValueError):
        files.sink_root({"EXPORT_TARGET": "ftp"})
    (tmp_path / "bands.yaml").write_text("bands:\n  rod: {low: 1, high: 2}\n  reel: {low: 3, high: 4}\n")
    assert rows(files.dimension(spark, str(tmp_path / "bands.yaml"), "bands", "name string, low int, high int"), "name", "low", "high") == [("reel", 3, 4), ("rod", 1, 2)]
    root = f"file://{tmp_path}/out"
    with pytest.raises(ValueError):
        files.read_feed(spark, root, "deal_id long")
    files.export_versioned({"deals": spark.range(3).withColumnRenamed("id", "deal_id")}, spark.range(1).select(F.lit(2).alias("schema_version")), root, "v")
    assert files.read_feed(spark, root, "deal_id long").count() == 3
    assert rows(files.run_summary({"a": spark.range(3), "b": spark.range(0)}), "name", "rows") == [("a", 3), ("b", 0)]


def test_slugs_are_unique_in_order(spark):
    names = ["Rod", "Rod", "Rod 2", "Rod", "Reel", "Reel", "Rod 2", "Rod 2 2", "Line", "Rod"]
    taken = ["line", "line-2", "rod-3"]
    used, expected = set(taken), []
    for name in names:
        base = slug = name.lower().replace(" ", "-")
        n = 2
        while slug in used:
            slug, n = f"{base}-{n}", n + 1
        used.add(slug)
        expected.append(slug)
    products = spark.createDataFrame(list(enumerate(names)), "product_id long, name string")
    got = [r.slug for r in catalog.unique_slugs(products, spark.createDataFrame([(t,) for t in taken], "slug string")).orderBy("product_id").collect()]
    assert got == expected and len(set(got)) == len(names)


def test_pages_that_share_a_url_expire_each_by_its_own_deal(spark, tmp_path):
    spark.createDataFrame([(1, "u"), (2, "u"), (3, "v"), (4, None), (5, None)], "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    spark.createDataFrame([(1, "O"), (2, "F"), (4, "O")], "o_orderkey long, o_orderstatus string").write.parquet(str(tmp_path / "orders.parquet"))
    got = sorted(r.page_id for r in QUERIES["expired_urls_without_open_deal"](spark, str(tmp_path)).collect())
    assert got == [2, 5]
