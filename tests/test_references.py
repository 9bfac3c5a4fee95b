"""References and guards on small histories."""

import random
from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from tidemark.operators import guards, references as R
from tidemark.sources import captures

SCHEMA = "offer_id long, observed_at timestamp, observed_date date, price_cents long, shipping_cents long, on_clearance boolean, quality string, availability string, seq string"


def history(spark, rows):
    made = [(o, datetime(2024, 1, 1) + timedelta(days=d), date(2024, 1, 1) + timedelta(days=d), p, None, c, q, "IN_STOCK", f"{k:04d}") for k, (o, d, p, c, q) in enumerate(rows)]
    return spark.createDataFrame(made, SCHEMA)


def test_own_median_needs_evidence(spark):
    rows = [(1, d, 13000, False, "OK") for d in range(10)]
    rows += [(2, d, 13000, False, "OK") for d in range(30)] + [(2, 30, 12000, False, "OK")]
    got = R.own_history_median(history(spark, rows), date(2024, 2, 1)).collect()
    assert [tuple(r) for r in got] == [(2, 13000, 31, 30)]


def test_clearance_is_dropped_before_or_after_the_last_row_of_a_day(spark):
    rows = [(1, 0, 10000, False, "OK"), (1, 0, 5000, True, "OK")]
    live = R.own_history_median(history(spark, rows), date(2024, 1, 2), min_days=1, min_span=0).first()
    assert live.reference_cents == 10000
    view = R.offer_reference_stats(R.offer_daily_price(history(spark, rows)), date(2024, 1, 2)).first()
    assert view.median_cents is None and view.days == 0


def test_cross_retailer_rules(spark):
    own = spark.createDataFrame([(1, 7, 2), (2, 8, None)], "offer_id long, variant_id long, unit_count long")
    at = datetime(2024, 1, 1)
    others = spark.createDataFrame(
        [
            (1, 7, 2, 1, 10, at, "a", 100), (3, 7, 2, 2, 11, at, "a", 12500), (4, 7, 2, 3, 12, at, "a", 12500), (5, 7, 3, 4, 13, at, "a", 50),
            (6, 8, None, 5, 14, at, "a", 70), (7, 7, 2, 6, 15, at, "a", 60),
        ],
        "offer_id long, variant_id long, unit_count long, retailer_id long, listing_id long, observed_at timestamp, seq string, price_cents long",
    )
    conflicts = spark.createDataFrame([(15, 7)], "listing_id long, variant_id long")
    got = R.cross_retailer_reference(own, others, conflicts).collect()
    assert [tuple(r) for r in got] == [(1, 12500, 2)]


def test_cross_retailer_equals_a_comparison_of_all_pairs(spark):
    rng = random.Random(8)
    rows = [(k, rng.randrange(4), rng.choice([1, 2, None]), rng.randrange(3), datetime(2024, 1, 1 + rng.randrange(5)), f"{k:03d}", rng.randrange(1, 60)) for k in range(90)]
    df = spark.createDataFrame(rows, "offer_id long, variant_id long, unit_count long, retailer_id long, observed_at timestamp, seq string, price_cents long")
    expected = {}
    for o, v, u, *_ in rows:
        latest = {}
        for r in sorted((x for x in rows if x[0] != o and (x[1], x[2]) == (v, u) and u is not None), key=lambda x: (x[4], x[5])):
            latest[r[3]] = r
        if latest:
            expected[o] = min((r[6], r[3]) for r in latest.values())
    assert {r.offer_id: (r.reference_cents, r.retailer_id) for r in R.cross_retailer_reference(df, df).collect()} == expected


def test_lower_reference_wins_and_own_wins_ties(spark):
    own = spark.createDataFrame([(1, 100), (2, 200), (3, 50)], "offer_id long, reference_cents long")
    cross = spark.createDataFrame([(1, 100), (2, 150), (4, 70)], "offer_id long, reference_cents long")
    got = {r.offer_id: (r.reference_cents, r.reference_kind) for r in R.verified_reference(own, cross).collect()}
    assert got == {1: (100, "OWN_HISTORY_MEDIAN_90D"), 2: (150, "CROSS_RETAILER_NEW"), 3: (50, "OWN_HISTORY_MEDIAN_90D"), 4: (70, "CROSS_RETAILER_NEW")}


def test_guards(spark):
    base = {"price_cents": 13000, "last_price": 13000, "band_floor": 1500, "band_ceiling": 200000, "currency": "USD"}
    cases = [
        ({}, "OK", []),
        ({"price_cents": 1000, "last_price": None}, "SUSPECT", ["out_of_band"]),
        ({"price_cents": None}, "REJECTED", ["invalid_price_or_currency"]),
        ({"currency": "CAD"}, "REJECTED", ["invalid_price_or_currency"]),
        ({"price_cents": 4000, "listing_unit_count": 1}, "SUSPECT", ["large_move"]),
        ({"price_cents": 12000}, "OK", []),
        ({"price_cents": 6500}, "OK", []),
        ({"on_clearance": True, "claimed_cents": 10000}, "SUSPECT", ["claimed_not_above_price"]),
        ({"unit_count": 2, "listing_unit_count": 3}, "SUSPECT", ["unit_mismatch"]),
        ({"variant_key": "a", "listing_variant_key": "b"}, "SUSPECT", ["variant_identity_changed"]),
        ({"previous_variants": 20, "variants": 5}, "SUSPECT", ["variant_collapse"]),
        ({"previous_prices": 5, "prices": 1}, "SUSPECT", ["price_flattening"]),
        ({"wording": "mint", "condition": None, "used_page": False}, "SUSPECT", ["condition_unknown"]),
        ({"wording": "mint", "condition": None, "used_page": True}, "OK", []),
    ]
    kinds = "i int, price_cents long, last_price long, band_floor long, band_ceiling long, currency string, on_clearance boolean, claimed_cents long, unit_count long, listing_unit_count long, variant_key string, listing_variant_key string, variants long, previous_variants long, prices long, previous_prices long, condition string, wording string, used_page boolean"
    names = [k.split()[0] for k in kinds.split(", ")]
    rows = [tuple((base | c | {"i": i}).get(n) for n in names) for i, (c, _, _) in enumerate(cases)]
    got = guards.judged(spark.createDataFrame(rows, kinds)).orderBy("i").select("quality", "quality_reasons").collect()
    assert [(r.quality, r.quality_reasons) for r in got] == [(q, r) for _, q, r in cases]


def test_guard_recurrence_skips_rejected_rows(spark):
    rows = [(1, 0, 10000, False, ""), (1, 1, 1000, False, ""), (1, 2, 9000, False, ""), (1, 3, 40000, False, ""), (1, 4, 9500, False, "")]
    got = guards.guard_recurrence(history(spark, rows)).orderBy("seq").collect()
    assert [(r.last_ok_cents, r.quality) for r in got] == [(None, "OK"), (10000, "SUSPECT"), (10000, "OK"), (9000, "SUSPECT"), (9000, "OK")]


def test_captures(spark):
    now = F.lit("2024-05-01 00:00:00").cast("timestamp")
    rows = [
        ("https://shop.example.com/a", "T\x07itle", None, None, 1000, 900, None, None),
        ("http://shop.example.com/a", "T", None, None, 1000, None, None, None),
        ("https://localhost/a", "T", None, None, 1000, None, None, None),
        ("https://shop.example.com/a", "T", "mint", None, 1000, None, None, None),
        ("https://shop.example.com/a", "T", "used", "usd", 0, None, None, None),
        (None, None, None, None, 1000, None, None, None),
        ("https://shop.example.com/a", "T", "used", "dollars", 10, 20, None, "short"),
    ]
    df = spark.createDataFrame(rows, "product_url string, title string, condition string, currency string, current_cents long, was_cents long, captured_at timestamp, idempotency_key string")
    got = captures.validate_captures(df, now).collect()
    assert [r.error for r in got] == [None, "product_url_not_https", "product_url_bad_host", "condition_unknown", "current_price_invalid", "product_url_missing", "currency_invalid"]
    assert (got[0].title, got[0].condition, got[0].was_cents, got[0].currency) == ("Title", "NEW", None, "USD")
    assert got[0].idempotency_key.startswith("auto_") and len(got[0].idempotency_key) == 45
