"""Scalar functions against rule vectors."""

from pyspark.sql import functions as F

from tidemark.functions import gtin, money, text, times, web
from tidemark.sources.captures import clean_text
from tidemark.sources.markup import stock_cell


def values(spark, column, rows, kind="string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, x {kind}")
    return [r.y for r in df.select("i", column(F.col("x")).alias("y")).orderBy("i").collect()]


def test_price_texts(spark):
    rows = ["$130.00", "6.99", "$1,299.99", "$99", "", "  ", None, "Call for price", "$0.00", "now $6.5 each", "-4.20"]
    assert values(spark, money.parse_price_cents, rows) == [13000, 699, 129999, 9900, None, None, None, None, None, 650, 420]
    assert values(spark, money.format_cents, [5, 130000, 699], "long") == ["$0.05", "$1300.00", "$6.99"]
    assert values(spark, money.dollars_to_cents, [12.34, 0.0, -1.0, None], "double") == [1234, None, None, None]


def test_discount_counts_half_a_percent_as_reached(spark):
    df = spark.createDataFrame([(6497, 13000), (5000, 0), (6000, 13000), (1, None)], "p long, r long")
    assert [r[0] for r in df.select(money.discount_bp(F.col("p"), F.col("r"))).collect()] == [5002, 0, 5385, None]


def test_gtin(spark):
    rows = ["0780647104070", "780647104070", "0", "780647104071", "junk", None, "00780647104070"]
    assert values(spark, gtin.normalize_gtin, rows) == ["00780647104070", "00780647104070", None, None, None, None, "00780647104070"]
    listed = spark.createDataFrame([(["780647104070", "bad", "0780647104070"],)], "g array<string>")
    assert listed.select(gtin.normalize_all(F.col("g"))).first()[0] == ["00780647104070"]


def test_names(spark):
    assert values(spark, text.slugify, ["Big Rod / 7'6\"!", "", None, "--"]) == ["big-rod-7-6", "item", "item", "item"]
    assert values(spark, text.brand_key, ["St. Croix", "  ", None]) == ["st_croix", None, None]
    assert values(spark, text.pack_count, ["10-Pack", "6 pk", "12ct", "3 count jar", "7 packs", "none", None]) == [10, 6, 12, 3, None, None, None]
    assert values(spark, text.rod_length_in, ["7'6\"", "7'", "6 ' 10", "long", None]) == [90, 84, 82, None, None]
    assert values(spark, text.rod_power, ["Medium - Fast", "MH - XF", "Medium", "a - b - c"]) == ["M", "MH", None, None]
    assert values(spark, text.condition_of, ["", None, "Excellent", " GOOD ", "mint"]) == ["NEW", "NEW", "USED_LIKE_NEW", "USED_GOOD", None]


def test_variant_keys_need_every_attribute(spark):
    df = spark.createDataFrame(
        [("hard_bait", {"length_in": "3", "color_key": "red"}), ("hard_bait", {"length_in": "3", "color_key": ""}), ("line", {"line_type": "mono"}), ("other", {}), (None, {})],
        "c string, a map<string,string>",
    )
    assert [r[0] for r in df.select(text.variant_key(F.col("c"), F.col("a"))).collect()] == ["length_in=3|color_key=red", None, None, None, None]


def test_rod_style_map(spark):
    df = spark.createDataFrame([({"Rod Length": "7'6\"", "Power - Taper": "Medium - Fast", "Type": "Spinning", "Pieces": "2 pc"},), ({"Style": "Casting rod", "Rod Type": "Spin"},)], "a map<string,string>")
    first, second = [r[0] for r in df.select(text.rod_attributes(F.col("a"))).collect()]
    assert first == {"rod_type": "spinning", "length_in": "90", "power": "M", "action": "F", "pieces": "2"}
    assert second == {"rod_type": "casting"}


def test_pages(spark):
    df = spark.createDataFrame(
        [(200, "fine SENTINEL"), (200, "please solve the CAPTCHA SENTINEL"), (403, "SENTINEL"), (404, "x"), (200, "other"), (200, " "), (200, None)], "s int, b string"
    )
    got = [tuple(r[0]) for r in df.select(web.page_outcome(F.col("s"), F.col("b"), ("SENTINEL",))).collect()]
    assert got == [("OK", None), ("BLOCKED", "captcha"), ("BLOCKED", "http_403"), ("NOT_FOUND", None), ("EMPTY", None), ("EMPTY", None), ("EMPTY", None)]
    assert values(spark, web.redact, ["postgres://u:pw@h/d?api_key=abc&x=1", None, "plain"]) == ["postgres://[REDACTED]@h/d?api_key=[REDACTED]&x=1", "", "plain"]
    assert values(spark, web.registrable_domain, ["www.shop.example.com", "localhost"]) == ["example.com", "localhost"]


def test_addresses_and_robots(spark):
    rows = ["8.8.8.8", "10.1.2.3", "127.0.0.1", "100.64.0.1", "::1", "2606:4700::1111", "::ffff:10.0.0.1", "nonsense", None]
    assert values(spark, web.is_public_ip, rows) == [True, False, False, False, False, True, False, False, False]
    assert values(spark, web.blocked_ipv4, ["8.8.8.8", "10.1.2.3", "198.19.0.1", "223.255.255.255"]) == [False, True, True, False]
    df = spark.createDataFrame([("User-agent: *\nDisallow: /cart\n", "bot", "https://h/a"), ("User-agent: *\nDisallow: /cart\n", "bot", "https://h/cart"), (None, "bot", "https://h/a")], "r string, a string, u string")
    assert [r[0] for r in df.select(web.robots_allow("r", "a", "u")).collect()] == [True, False, False]


def test_times_and_cells(spark):
    df = spark.sql("select timestamp'2024-03-10 04:30:15.9' as t")
    day, stamp = df.select(times.eastern_day(F.col("t")).cast("string"), times.iso_z(F.col("t"))).first()
    assert (day, stamp) == ("2024-03-09", "2024-03-10T04:30:15Z")
    assert [tuple(x) for x in values(spark, stock_cell, ["4", "10+", "09/20", "14 Days", "0", "call", None])] == [
        (4, False, "IN_STOCK"), (10, True, "IN_STOCK"), (None, False, "BACKORDER"), (None, False, "BACKORDER"), (0, False, "OUT_OF_STOCK"), (None, False, "UNKNOWN"), (None, False, "UNKNOWN"),
    ]
    assert values(spark, lambda c: clean_text(c, 100), ["é", None]) == ["é", None]
