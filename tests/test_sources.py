"""Feed and page parsers, document sinks and merges on small inputs."""

import json

import pyarrow as pa
from pyspark.sql import functions as F

from tidemark.operators import documents, work
from tidemark.operators.latest import array_overlap_join, keyed_merge, unseen
from tidemark.plans import q_sources
from tidemark.sources import feeds, files, markup


def page(spark, body, url="u", host="h"):
    return spark.createDataFrame([(url, host, body)], "url string, host string, body string")


def test_collection_takes_the_cheapest_available_variant(spark):
    variants = [
        {"id": 1, "title": "a", "sku": "A", "available": False, "price": "10.00", "compare_at_price": "20.00"},
        {"id": 2, "title": "b", "sku": "B", "available": True, "price": "48.99", "compare_at_price": "64.99"},
        {"id": 3, "title": "c", "sku": "C", "available": True, "price": "50.00", "compare_at_price": None},
    ]
    body = json.dumps({"products": [{"id": 9, "title": "T", "handle": "t", "vendor": "V", "tags": ["x"], "variants": variants}, {"id": 8, "title": "U", "handle": "u", "vendor": "V", "variants": []}]})
    rows = {r.product_code: r for r in feeds.collection_rows(page(spark, body)).collect()}
    assert (rows[9].price_cents, rows[9].claimed_cents, rows[9].price_is_range, rows[9].available, rows[9].product_url) == (4899, 6499, True, True, "https://h/products/t")
    assert rows[8].price_cents is None
    assert feeds.collection_rows(page(spark, "{broken")).count() == 0


def test_feed_outcomes(spark):
    bodies = ['{"products":[{"id":1}]}', '{"products":[]}', '{"other":1}', "", None, "<html>"]
    df = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "i int, b string")
    outcome = feeds.feed_outcome(F.col("b"), F.from_json("b", feeds.COLLECTION)["products"])
    assert [r[0] for r in df.orderBy("i").select(outcome).collect()] == ["OK", "EMPTY", "STRUCTURE_CHANGED", "EMPTY", "EMPTY", "STRUCTURE_CHANGED"]


def test_product_feed(spark):
    body = json.dumps({"id": 1, "title": "Worm 10-Pack", "vendor": "V", "options": [{"name": "Size", "position": 2, "values": ["3"]}, {"name": "Color", "position": 1, "values": ["Red"]}], "variants": [
        {"id": 5, "title": "Red / 3", "option1": "Red", "option2": "3", "sku": "", "available": True, "price": 4899, "compare_at_price": 6499, "barcode": "780647104070"}]})
    r = feeds.product_offers(page(spark, body)).first()
    assert (r.sku, r.price_cents, r.claimed_cents, r.availability, r.attributes, r.gtin14, r.unit_count) == ("5", 4899, 6499, "IN_STOCK", {"color": "Red", "size": "3"}, ["00780647104070"], 10)


def test_search_and_catalogue_feeds(spark):
    search = json.dumps({"results": [{"raw": {"title": "T", "sku": "S", "offerprice": 9.99, "listprice": 19.99, "minofferprice": 9.99, "maxofferprice": 12.0}}, {"raw": {"title": "U", "sku": "V", "offerprice": 5.0, "listprice": 5.0}}]})
    assert [(r.product_code, r.price_cents, r.claimed_cents, r.price_is_range) for r in feeds.search_rows(page(spark, search)).collect()] == [("S", 999, 1999, True), ("V", 500, None, False)]
    catalogue = json.dumps({"productVOs": [
        {"name": "N", "partnumber": "P", "parentPartnumber": "PP", "assetSeoUrl": "/p/n", "dsgPriceIndicators": {"priceIndicator": 0}, "floatFacets": [{"identifier": "otherofferprice", "value": 1.0}, {"identifier": "dickssportinggoodsofferprice", "value": 30.0}, {"identifier": "dickssportinggoodslistprice", "value": 60.0}]},
        {"name": "M", "partnumber": "O", "assetSeoUrl": "/p/m", "floatFacets": [{"identifier": "dickssportinggoodsofferprice", "value": 30.0}, {"identifier": "dickssportinggoodsofferprice", "value": 35.0}]},
        {"name": "E", "partnumber": "E", "assetSeoUrl": "https://elsewhere.example/p", "floatFacets": [{"identifier": "dickssportinggoodsofferprice", "value": 30.0}]},
        {"name": "Z", "partnumber": "Z", "assetSeoUrl": "/p/z", "floatFacets": [{"identifier": "otherofferprice", "value": 30.0}]},
        {"name": "H", "partnumber": "Q", "dsgPriceIndicators": {"priceIndicator": 1}, "assetSeoUrl": "/p/q", "floatFacets": [{"identifier": "dickssportinggoodsofferprice", "value": 30.0}]}]})
    assert [(r.product_code, r.price_cents, r.claimed_cents) for r in feeds.catalog_rows(page(spark, catalogue)).collect()] == [("PP", 3000, 6000), ("O", 3500, None)]


def test_json_ld_groups_and_lists(spark):
    group = {"@type": "ProductGroup", "brand": {"name": "B"}, "hasVariant": [{"sku": "a", "name": "A", "gtin12": "780647104070", "offers": {"price": "5.00", "availability": "https://schema.org/InStock"}}, {"sku": "b", "name": "Bb", "offers": {"price": "0", "availability": "http://schema.org/OutOfStock"}}]}
    listed = {"@type": "ItemList", "itemListElement": [{"item": {"name": "L", "url": "https://x/l", "mpn": "m1", "offers": {"lowPrice": "7.5"}}}]}
    body = f"<script type='application/ld+json'>{json.dumps([group])}</script><script type=\"application/ld+json\">{json.dumps(listed)}</script>"
    rows = markup.json_ld_offers(page(spark, body)).orderBy("sku").collect()
    assert [(r.sku, r.brand, r.price_cents, r.availability, r.gtin14) for r in rows] == [("a", "B", 500, "IN_STOCK", ["00780647104070"]), ("b", "B", None, "OUT_OF_STOCK", [])]
    assert [(r.product_code, r.price_cents) for r in markup.json_ld_list_rows(page(spark, body)).collect()] == [("m1", 750)]


def test_json_ld_offers_in_a_list(spark):
    product = {"@type": "Product", "name": "Worms 12 pack", "sku": 5, "offers": [{"price": 189.97, "availability": "http://schema.org/instoreonly"}, {"price": "20.00", "itemCondition": "https://schema.org/UsedCondition"}, {"price": "odd"}]}
    bare = {"@type": "Product", "name": "Bare", "sku": "6"}
    group = {"@type": "ProductGroup", "name": "Group", "hasVariant": [{"sku": "7", "offers": [{"price": 1}]}]}
    body = f"<script type='application/ld+json'>{json.dumps([product, bare, group])}</script>"
    got = [(r.sku, r.title, r.price_cents, r.availability, r.condition, r.unit_count) for r in markup.json_ld_offers(page(spark, body)).collect()]
    assert sorted(got, key=str) == sorted([
        ("5", "Worms 12 pack", 18997, "STORE_ONLY", "NEW", 12), ("5", "Worms 12 pack", 2000, "UNKNOWN", "USED_UNGRADED", 12), ("5", "Worms 12 pack", None, "UNKNOWN", "NEW", 12),
        ("6", "Bare", None, "UNKNOWN", "NEW", None), ("7", "Group", None, "UNKNOWN", "NEW", None),
    ], key=str)
    shop = spark.createDataFrame([("https://h/p", "h", body)], "url string, host string, body string")
    assert [(r.title, r.current_cents) for r in markup.browser_capture(shop, {}).collect()] == [("Worms 12 pack", 18997)]


def test_used_goods_and_closeouts(spark):
    def offers(told, row):
        body = f"""<h1>Rod</h1><div id="product_overview"><div class="product-description"><p>{told}</p></div></div><table><tr class="js-ordering-subproduct" {row}><td><strong class="js-ordering-name">V</strong>
        <span class="js-ordering-price">200.00</span><span class="js-ordering-available">1</span></td></tr></table>"""
        r = markup.spec_offers(spark.createDataFrame([("https://h/p", body)], "url string, body string"), "ordering_rows").first()
        return r.price_cents, r.condition, r.condition_raw, r.claimed_cents, r.claimed_kind, r.on_clearance, r.seller_type

    assert offers("MSRP $299.99 - Excellent condition. Handle slightly dirty", 'data-code="USEDX" data-list-price="250.00"') == (20000, "USED_LIKE_NEW", "excellent", 29999, "MSRP", True, "RETAILER_RESALE")
    assert offers("MSRP $299.99 - Strange condition", 'data-code="X"') == (20000, "USED_UNGRADED", "strange", 29999, "MSRP", True, "RETAILER_RESALE")
    assert offers("Nice", 'data-code="used-1" data-list-price="250.00"') == (20000, "USED_UNGRADED", None, 25000, "WAS", True, "RETAILER_RESALE")
    assert offers("Nice", 'data-code="N" data-closeout-item data-list-price="250.00"') == (20000, "NEW", None, 25000, "WAS", True, "FIRST_PARTY")
    assert offers("Nice", 'data-code="N" data-list-price="250.00"') == (20000, "NEW", None, None, None, False, "FIRST_PARTY")
    listed = spark.createDataFrame([("https://shop/l", '<div class="cattable-wrap-cell" data-code="U"></div>')], "url string, body string")
    assert [markup.grid_rows(listed, "catalogue_cells", used=u).first().condition_hint for u in (True, False)] == ["USED_UNGRADED", None]


def test_grids(spark):
    def got(body, family):
        made = markup.grid_rows(spark.createDataFrame([("https://shop/list?x=1", body)], "url string, body string"), family).orderBy("ord").collect()
        return [(r.product_code, r.title, r.price_cents, r.claimed_cents, r.claimed_kind, r.price_is_range, r.product_url) for r in made]

    def cell(code, price, was):
        return f"""<div class="cattable-wrap-cell gtm_impression" data-code="{code}"><a class="cattable-wrap-cell-info" href="https://shop/d-{code}.html%0D"><div class="cattable-wrap-cell-info-flag sale">-51%</div>
        <h3 class="cattable-wrap-cell-info-name">Rod <b>{code}</b></h3><div class="cattable-wrap-cell-info-price is-sale">
        $<span>{price}</span><span class="cattable-wrap-cell-info-price-msrp">{was}</span></div></a></div>"""

    catalogue = cell("C1", "129.97", '<span class="is-crossout">$269.99</span>*') + cell("C2", "99.97", '<span class="is-crossout">$142.99</span>') + cell("C3", "Call", "") + "<div>$1</div>"
    assert got(catalogue, "catalogue_cells") == [
        ("C1", "Rod C1", 12997, 26999, "MSRP", False, "https://shop/d-C1.html"), ("C2", "Rod C2", 9997, 14299, "WAS", False, "https://shop/d-C2.html"), ("C3", "Rod C3", None, None, None, False, "https://shop/d-C3.html"),
    ]

    def item(code, price, before):
        return f"""<div class="product-item js-product-item" data-product-code="{code}"><a class="thumb" href="/t/{code}"></a><h2 class="details"><a class="name" href="/p/{code}">Reel {code}</a></h2>
        <div class="price"><div class="smw-sale-price displayed-price">{price}<span class="price-before price-del currency"><span class="sr-only">Original price:</span>{before}</span></div></div></div>"""

    items = item("p1", "$48.92 - $59.99", '<span class="price-strikethrough">$59.99 - $69.99</span>') + item("p2", '<span class="sr-only">Sale price:</span> $63.97', '$<span class="price-strikethrough">69.99</span>') + item("p3", "$204.77 - $300.00", "")
    assert got(items, "product_items") == [
        ("p1", "Reel p1", 4892, 5999, "WAS", True, "https://shop/p/p1"), ("p2", "Reel p2", 6397, 6999, "WAS", False, "https://shop/p/p2"), ("p3", "Reel p3", 20477, None, None, True, "https://shop/p/p3"),
    ]

    def tile(code, badge, was):
        return f"""<div class="product-tile" role="group"><div class="image-banner red">{badge}</div><a class="anchor-container" href="/product/{code}?a=3" pid="{code}"><div class="product-name"><span>Tile {code}</span></div>
        <span class="regular-price"> $59.99 <span class="slash"> /</span></span><span class="club-price">$53.99</span><span class="was-price"><span class="price-label">Was</span>{was}</span></a></div>"""

    tiles = tile("1", "On Sale", '<span class="price strike">$89.99</span>') + tile("2", "Members Only Deal", "") + tile("3", "Clearance", "") + tile("4", "Clearance", '<span class="price strike">$59.99</span>')
    assert got(tiles, "badge_tiles") == [("1", "Tile 1", 5999, 8999, "WAS", False, "https://shop/product/1?a=3")]
    card = """<div class="product-card-wrapper" data-vendor="v"><a class="product-card" href="/products/x"><img src="i.jpg"><h2 class="product-title"> <span>Card</span></h2>
    <div class="yotpo bottomLine" data-product-id="42" data-price="1"></div>{}<div class="product-price"><span class="current-price "> $219.99 </span></div></a></div>"""
    assert got(card.format('<span class="fromtag">From<br></span>') + card.format(""), "product_cards") == [("42", "Card", 21999, None, None, k == 0, "https://shop/products/x") for k in range(2)]
    assert got("", "product_items") == [] and got("<p>Access denied", "badge_tiles") == []


def test_export_promotes_meta_last_and_prunes(spark, tmp_path):
    root = f"file://{tmp_path}"
    deals = spark.createDataFrame([(1, "a"), (2, "b")], "deal_id long, name string")
    meta = spark.range(1).select(F.lit(2).alias("schema_version"))
    assert files.read_latest(spark, root, "deals", "deal_id long") is None
    for version in ("v1", "v2", "v3"):
        files.export_versioned({"deals": deals}, meta, root, version, promote=version != "v3")
    assert files.read_latest(spark, root, "deals", "deal_id long, name string").count() == 2
    assert files.read_latest(spark, root, "meta", "schema_version int").first()[0] == 2
    assert len(files.prune_versions(spark, root, keep=1)) == 2
    listing = spark.createDataFrame([(f"f{k}", k) for k in range(7)], "path string, modified long")
    assert {r.path for r in files.newest_versions(listing).collect()} == {"f0", "f1"}


def test_fixture_pages(spark, tmp_path):
    (tmp_path / "a.html").write_text("hello")
    requests = spark.createDataFrame([("https://x/a",), ("https://x/b",)], "url string")
    manifest = spark.createDataFrame([("https://x/a", "a.html")], "url string, file string")
    got = {r.url: (r.status, r.body) for r in files.fixture_pages(spark, requests, manifest, str(tmp_path)).collect()}
    assert got == {"https://x/a": (200, "hello"), "https://x/b": (404, None)}


def test_merges(spark):
    current = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    batch = spark.createDataFrame([(2, "x"), (3, "y")], "k int, v string")
    merged = keyed_merge(current, batch, ["k"], {"v": F.coalesce("b.v", "c.v")})
    assert sorted(map(tuple, merged.collect())) == [(1, "a"), (2, "x"), (3, "y")]
    rows = spark.createDataFrame([(1, "", 1), (1, "", 2), (1, "r", 3), (1, "r", 4), (2, "s", 5)], "k int, ref string, n int")
    stored = spark.createDataFrame([(2, "s")], "k int, ref string")
    assert sorted(r.n for r in unseen(rows, stored, ["k", "ref"], [F.asc("n")], F.col("ref") == "").collect()) == [1, 2, 3]
    left = spark.createDataFrame([(1, ["a", "b"]), (2, []), (3, None), (4, ["z"])], "l int, g array<string>")
    right = spark.createDataFrame([(10, ["b"]), (9, ["a", "q"]), (11, None)], "r int, g array<string>")
    assert [tuple(r) for r in array_overlap_join(left, right, "g", "l", "r").collect()] == [(1, 9)]


def test_cap_counts_only_new_items(spark):
    items = spark.createDataFrame([(1, k, k % 2 == 0) for k in range(6)], "retailer_id int, ord int, known boolean")
    room = spark.createDataFrame([(1, 2)], "retailer_id int, free int")
    assert [r.enrolled for r in work.capped(items, room).orderBy("ord").collect()] == [True, True, True, True, True, False]


def test_documents_and_gate(spark):
    rows = [(1, "CLAIMED", "FIRST_PARTY", 100, 10, None), (2, "VERIFIED", "ODD", 100, 10, None), (3, "VERIFIED", "FIRST_PARTY", 100, 10, 300)]
    docs = spark.createDataFrame(rows, "deal_id long, lane string, seller_type string, price_cents long, discount_bp long, reference_cents long")
    assert sorted(map(tuple, documents.feed_violations(docs).collect())) == [(2, "seller_enum"), (2, "verified_with_reference")]
    health = spark.createDataFrame([(1, True), (2, True)], "retailer_id int, stale boolean")
    assert not documents.publishable(health, 0) and documents.publishable(health, 1) and documents.publishable(health, 0, force=True)


def test_plain_markup_reads_as_the_standard_parser_reads_it():
    family = markup.GRIDS["catalogue_cells"]
    cell = '<div class="cattable-wrap-cell" data-code="{k}"><a class=\'cattable-wrap-cell-info\' href="/p/{k}"><h3 class="cattable-wrap-cell-info-name">A &amp; <b>{k}</b></h3><img src="i"/><div class="cattable-wrap-cell-info-price">$1.00<span class="cattable-wrap-cell-info-price-msrp">$2.00</span>\n</div></a></div>'
    page = "<!DOCTYPE html><ul>" + "".join(cell.format(k=k) for k in range(3)) + "</ul>"
    odd = [page.replace("<ul>", more) for more in ("<!-- a<b -->", "<script>if (a<b) {}</script>", "<p a=b>", "5 < 6", "<title>x</title>", '<p title="&lt;">')]
    assert markup._plain_tags(page) and not any(map(markup._plain_tags, odd))
    for body in [page, *odd, page[:-30], ""]:
        parser = markup._Cells(family)
        parser.feed(body)
        parser.close()
        assert markup.cells_of(body, family) == parser.rows
    assert [r["title"] for r in markup.cells_of(page, family)] == ["A & 0", "A & 1", "A & 2"]


def test_pages_made_from_one_file_are_read_by_many_tasks(spark, tmp_path):
    spark.range(100).select(F.col("id").alias("p_partkey")).coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    pages = q_sources._parts(spark, str(tmp_path), F.lit("<p>"))
    assert pages.rdd.getNumPartitions() > 1 and pages.count() == 100


def test_cells_go_on_in_small_batches(spark, monkeypatch):
    monkeypatch.setattr(markup, "CELLS", 10)
    body = '<div class="product-tile"></div>' * 7
    pages = spark.range(50, numPartitions=1).select(F.col("id").cast("string").alias("url"), F.lit(body).alias("body"))
    sent = []
    monkeypatch.setattr(type(pages), "mapInArrow", lambda _, run, schema: sent.append(run))
    markup.grid_cells(pages, "badge_tiles")
    batch = pa.RecordBatch.from_pydict({"body": [body] * 50, "url": [str(k) for k in range(50)]})
    sizes = [b.num_rows for b in sent[0](iter([batch]))]
    assert sum(sizes) == 350 and max(sizes) < 20


def test_badge_tile_without_a_link_stands_for_its_page(spark):
    tile = '<div class="product-tile"><div class="image-banner">Clearance</div><a class="anchor-container" pid="7"><div class="product-name"><span>Tile</span></div><span class="regular-price">$5.00</span><span class="price strike">$9.00</span></a></div>'
    pages = spark.createDataFrame([("https://shop/list", tile)], "url string, body string")
    assert [(r.product_code, r.product_url, r.claimed_cents) for r in markup.grid_rows(pages, "badge_tiles").collect()] == [("7", "https://shop/list", 900)]
