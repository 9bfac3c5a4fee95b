"""Confirmation checks, the deal machine in batch and as a stream, and pacing folds."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.config import RULES
from tidemark.operators import pacing, rules
from tidemark.operators.deal_machine import INPUT, basis_points, deal_events, deal_states
from tidemark.streaming.deals import STATE_STORE, deal_event_stream, first_snapshots

START = datetime(2024, 5, 1, 12)
NAMES = [c.strip().split(" ")[0] for c in INPUT.split(",")]


def row(k, minutes, price, **other):
    base = {"offer_id": 1, "seq": f"{k:03d}", "observed_at": START + timedelta(minutes=minutes), "price_cents": price, "quality": "OK", "condition": "NEW", "availability": "IN_STOCK", "on_clearance": False, "verified_cents": 13000, "floor_cents": 1500, "snapshot_ref": f"s{k}"}
    return tuple((base | other).get(n) for n in NAMES)


def fold(spark, rows, **options):
    got = deal_events(spark.createDataFrame(rows, INPUT), **options).where("event <> 'confirm_due'").orderBy("offer_id", "observed_at", "seq", "event").collect()
    return [(r.event, r.status, r.reason) for r in got]


def test_two_sweeps_confirm_and_a_third_refreshes(spark):
    rows = [row(k, 15 * k, 6000, verified_cents=None, claimed_cents=13000, on_clearance=True) for k in range(3)]
    got = deal_events(spark.createDataFrame(rows, INPUT)).where("event <> 'confirm_due'").orderBy("seq").collect()
    assert [(r.event, r.status, r.rule, r.discount_bp) for r in got] == [
        ("detected", "CONFIRMING", "DEEP_DISCOUNT_CLAIMED", 5385),
        ("confirmed", "ACTIVE", "DEEP_DISCOUNT_CLAIMED", 5385),
        ("refreshed", "ACTIVE", "DEEP_DISCOUNT_CLAIMED", 5385),
    ]


@pytest.mark.parametrize(
    ("rows", "expected"),
    [
        ([row(0, 0, 6497), row(1, 5, 6497), row(2, 15, 6497)], [("detected", "CONFIRMING", None), ("waiting", "CONFIRMING", "confirm_too_soon"), ("confirmed", "ACTIVE", None)]),
        ([row(0, 0, 6000, detected_via="DISCOVERY_GRID"), row(1, 15, 6000, page_type="CLEARANCE_LISTING")], [("detected", "CONFIRMING", None), ("rejected", "REJECTED", "confirm_not_from_product_page")]),
        ([row(0, 0, 6000, identity="a|NEW"), row(1, 15, 6000, identity="b|NEW")], [("detected", "CONFIRMING", None), ("rejected", "REJECTED", "offer_identity_mismatch")]),
        ([row(0, 0, 6000, variant_key="k"), row(1, 15, 6000, variant_key="k", listing_key="l")], [("detected", "CONFIRMING", None), ("rejected", "REJECTED", "variant_mismatch")]),
        ([row(0, 0, 6000, unit_count=2, listing_units=2), row(1, 15, 6000, unit_count=2)], [("detected", "CONFIRMING", None), ("rejected", "REJECTED", "variant_mismatch")]),
        ([row(0, 0, 6000), row(1, 15, 6000, quality="SUSPECT", other_reason="out_of_band")], [("detected", "CONFIRMING", None), ("rejected", "REJECTED", "quality:out_of_band")]),
        ([row(0, 0, 6000), row(1, 15, 6000, verified_cents=11000)], [("detected", "CONFIRMING", None), ("rejected", "REJECTED", "below_threshold_on_confirm")]),
        ([row(k, 15 * k, 6000, variant_key="k", listing_key="k", reference_key="z") for k in range(2)], [("detected", "CONFIRMING", None), ("rejected", "REJECTED", "reference_scope_mismatch")]),
        ([row(k, 15 * k, 6000, unit_count=2, listing_units=2, reference_units=3) for k in range(2)], [("detected", "CONFIRMING", None), ("rejected", "REJECTED", "reference_scope_mismatch")]),
        ([row(k, 15 * k, 1400) for k in range(2)], [("detected", "CONFIRMING", None), ("rejected", "REJECTED", "below_floor")]),
        ([row(0, 0, 6000), row(1, 15, 6500)], [("detected", "CONFIRMING", None), ("rejected", "REJECTED", "price_changed")]),
        ([row(0, 0, 1600), row(1, 15, 1600)], [("detected", "CONFIRMING", None), ("confirmed", "HELD_REVIEW", "discount_85_to_95")]),
        ([row(0, 0, 1950), row(1, 15, 1950)], [("detected", "CONFIRMING", None), ("confirmed", "ACTIVE", None)]),
        ([row(0, 0, 600), row(1, 15, 600, floor_cents=None)], [("detected", "CONFIRMING", None), ("rejected", "REJECTED", "implausible_discount")]),
        ([row(0, 0, 6000), row(1, 15, 6000), row(2, 30, 6000, availability="OUT_OF_STOCK")], [("detected", "CONFIRMING", None), ("confirmed", "ACTIVE", None), ("expired", "EXPIRED", "sold_out")]),
        ([row(0, 0, 6000), row(1, 15, 6000), row(2, 30, 9000)], [("detected", "CONFIRMING", None), ("confirmed", "ACTIVE", None), ("expired", "EXPIRED", "price_recovered")]),
        ([row(0, 0, 6000), row(1, 15, 6000, snapshot_ref="s0")], [("detected", "CONFIRMING", None)]),
        ([row(0, 0, 6000), row(1, 15, 6000, quality="REJECTED")], [("detected", "CONFIRMING", None), ("rejected", "REJECTED", "quality:rejected")]),
        ([row(0, 0, 6000), row(1, 15, 6000, quality="SUSPECT")], [("detected", "CONFIRMING", None), ("confirmed", "ACTIVE", None)]),
        ([row(0, 0, 6000), row(1, 200, 6000)], [("rejected", "REJECTED", "confirm_deadline_missed"), ("detected", "CONFIRMING", None), ("detected", "CONFIRMING", None)]),
        ([row(0, 0, None), row(1, 15, 12900)], []),
    ],
)
def test_scenarios(spark, rows, expected):
    assert sorted(fold(spark, rows), key=str) == sorted(expected, key=str)


def test_used_goods_are_rejected_unless_allowed(spark):
    rows = [row(k, 15 * k, 4000, condition="USED_GOOD", current_new_cents=10000, shipping_cents=500) for k in range(2)]
    assert fold(spark, rows)[1] == ("rejected", "REJECTED", "reference_scope_mismatch")
    assert fold(spark, rows, used_reference=True)[1] == ("confirmed", "ACTIVE", None)


def test_timers_fire_at_their_own_time(spark):
    until = lambda minutes: int((START - datetime(1970, 1, 1)).total_seconds() + 60 * minutes) * 1_000_000
    told = lambda rows, minutes: [(r.event, r.reason, (r.observed_at - START).total_seconds() / 60) for r in deal_events(spark.createDataFrame(rows, INPUT), until=until(minutes)).orderBy("observed_at").collect()]
    one = [row(0, 0, 6000)]
    assert told(one, 10) == [("detected", None, 0)]
    assert told(one, 11) == [("detected", None, 0), ("confirm_due", None, 10)]
    assert told(one, 180)[2:] == [] and told(one, 181)[2:] == [("rejected", "confirm_deadline_missed", 180)]
    active = [row(0, 0, 6000), row(1, 15, 6000), row(2, 60, 6000, quality="SUSPECT"), row(3, 1500, 6000)]
    assert told(active, 1455)[3:] == [] and told(active, 1456)[3:] == [("expired", "not_observed", 1455)]
    # The observation after the expiry starts anew; the one just at 24 hours would have kept the deal.
    assert [e for e, _, _ in told(active, 1501)] == ["detected", "confirm_due", "confirmed", "expired", "detected"]
    assert [e for e, _, _ in told([*active[:2], row(3, 1455, 6000)], 1456)] == ["detected", "confirm_due", "confirmed", "refreshed"]


def test_states_of_deals(spark):
    rows = [row(0, 0, 6000), row(1, 15, 5900), row(2, 30, 5800), row(3, 45, 9000), row(4, 60, 6000), row(5, 75, 6000, verified_cents=11000), row(6, 90, 6100, verified_cents=11000)]
    got = deal_states(deal_events(spark.createDataFrame(rows, INPUT))).orderBy("number").collect()
    assert [(r.number, r.detected_seq, r.status, r.reason, r.price_cents, r.reference_cents, r.refreshes) for r in got] == [
        (1, "000", "EXPIRED", "price_recovered", 5800, 13000, 1), (2, "004", "REJECTED", "below_threshold_on_confirm", 6000, 13000, 0),
    ]
    assert [((r.confirmed_at - START).seconds // 60 if r.confirmed_at else None, (r.closed_at - START).seconds // 60) for r in got] == [(15, 45), (None, 75)]


def test_replays_are_remembered_for_a_time(spark):
    rows = [row(0, 0, 6000, snapshot_ref="s"), row(1, 20, 6000, snapshot_ref="s"), row(2, 8 * 1440, 6000, snapshot_ref="s"), row(3, 8 * 1440 + 20, 6000, snapshot_ref="")]
    got = [(r.event, r.seq) for r in deal_events(spark.createDataFrame(rows, INPUT)).where("event <> 'confirm_due'").orderBy("observed_at").collect()]
    assert got == [("detected", "000"), ("rejected", "000"), ("detected", "002"), ("confirmed", "003")]


def test_odd_rows(spark):
    rows = [row(0, 0, 6000, offer_id=None), row(1, 15, 6000, offer_id=None), row(2, 0, None), row(3, 0, 6000, observed_at=None), row(4, 1, 6000, offer_id=6, quality=None, snapshot_ref=None), row(5, 0, 0, offer_id=7, verified_cents=0)]
    got = deal_events(spark.createDataFrame(rows, INPUT)).where("event <> 'confirm_due'").collect()
    assert sorted((r.event, r.offer_id) for r in got) == [("confirmed", None), ("detected", None)]
    assert deal_events(spark.createDataFrame([], INPUT)).count() == 0


def test_a_stream_in_any_order_gives_the_events_of_the_batch(spark, tmp_path):
    """Rows arrive shuffled by up to half an hour, in batches; emitted is what the batch has up to the watermark."""
    rng = random.Random(11)
    rows = [row(k, 7 * k, 6000 if k % 9 else 12000, offer_id=k % 3 or None, snapshot_ref=f"s{k - k % 5 % 2}", availability="OUT_OF_STOCK" if k % 11 == 0 else "IN_STOCK") for k in range(240)]
    arrived = sorted(rows, key=lambda r: r[NAMES.index("observed_at")] + timedelta(minutes=rng.uniform(0, 30)))
    for part in range(6):
        batch = spark.createDataFrame(arrived[40 * part : 40 * part + 40], INPUT).coalesce(1)
        batch.write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(INPUT).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    spark.conf.set(*STATE_STORE)
    try:
        # Two runs over the same progress: the second goes on where the first ended.
        for _ in range(2):
            run = deal_event_stream(stream, "31 minutes").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start(str(tmp_path / "out"))
            run.awaitTermination()
    finally:
        spark.conf.unset(STATE_STORE[0])
    streamed = sorted(map(str, spark.read.parquet(str(tmp_path / "out")).collect()))
    newest = max(r[NAMES.index("observed_at")] for r in rows)
    until = int((newest - timedelta(minutes=31) - datetime(1970, 1, 1)).total_seconds() * 1000) * 1000
    assert streamed == sorted(map(str, deal_events(spark.createDataFrame(rows, INPUT), until=until).collect())) and len(streamed) > 100


def test_first_snapshots(spark):
    df = spark.createDataFrame([row(0, 0, 1, snapshot_ref="a"), row(1, 1, 1, snapshot_ref="a"), row(2, 2, 1, snapshot_ref="b")], INPUT)
    assert first_snapshots(df).count() == 2


def test_confirm_columns(spark):
    fields = {
        "minutes_since_detection": F.lit(15), "detected_via": F.lit("PAGE"), "page_type": F.lit("PRODUCT"), "same_offer": F.lit(True), "detected_key": F.lit("k"), "confirming_key": F.lit("k"),
        "listing_key": F.lit("k"), "detected_units": F.lit(None).cast("int"), "confirming_units": F.lit(None).cast("int"), "listing_units": F.lit(None).cast("int"), "quality": F.lit("OK"),
        "other_reason": F.lit(None).cast("string"), "price_cents": F.lit(6497), "detected_cents": F.lit(6497), "reference_cents": F.lit(13000), "reference_key": F.lit(None).cast("string"),
        "reference_units": F.lit(None).cast("int"), "reference_group": F.lit("NEW"), "condition_group": F.lit("NEW"), "floor_cents": F.lit(1500),
    }
    changed = [
        ({}, ("ACTIVE", None)),
        ({"minutes_since_detection": F.lit(5)}, ("REJECTED", "confirm_too_soon")),
        ({"detected_via": F.lit("GRID"), "page_type": F.lit("LISTING")}, ("REJECTED", "confirm_not_from_product_page")),
        ({"same_offer": F.lit(False)}, ("REJECTED", "offer_identity_mismatch")),
        ({"confirming_units": F.lit(1)}, ("REJECTED", "variant_mismatch")),
        ({"quality": F.lit("SUSPECT"), "other_reason": F.lit("out_of_band")}, ("REJECTED", "quality:out_of_band")),
        ({"quality": F.lit("SUSPECT")}, ("ACTIVE", None)),
        ({"price_cents": F.lit(6700)}, ("REJECTED", "price_changed")),
        ({"reference_cents": F.lit(12000)}, ("REJECTED", "below_threshold_on_confirm")),
        ({"reference_units": F.lit(2)}, ("ACTIVE", None)),
        ({"condition_group": F.lit("USED")}, ("REJECTED", "reference_scope_mismatch")),
        ({"floor_cents": F.lit(7000)}, ("REJECTED", "below_floor")),
        ({"reference_cents": F.lit(6497 * 30)}, ("REJECTED", "implausible_discount")),
        ({"reference_cents": F.lit(6497 * 10)}, ("HELD_REVIEW", None)),
    ]
    for change, expected in changed:
        got = spark.range(1).select(rules.confirm((fields | change).__getitem__).alias("c")).first().c
        assert (got.status, got.reject_reason) == expected


def test_basis_points_round_like_the_column(spark):
    pairs = [(p, r) for r in (1999, 13000, 777) for p in range(1, r, 97)]
    df = spark.createDataFrame(pairs, "p long, r long")
    from tidemark.functions.money import discount_bp

    assert [x[0] for x in df.select(discount_bp(F.col("p"), F.col("r"))).collect()] == [basis_points(p, r) for p, r in pairs]
    assert RULES.min_discount_bp == 5000


def test_pacing():
    held = pacing.Window60(2, 60)
    assert [held.ask(t) for t in [0, 1, 2, 3, 61]] == [True, True, False, False, True]
    gate = pacing.Gate(pacing.Budget(min_delay=10, per_hour=2, per_day=4, reserved=0.5), pacing.Breaker())
    asked = [(0, "ENROLL"), (5, "ENROLL"), (20, "ENROLL"), (40, "ENROLL"), (3700, "ENROLL"), (3720, "CONFIRM"), (7400, "CONFIRM"), (7500, "CONFIRM")]
    assert [gate.ask(t, kind, False) for t, kind in asked] == ["ok", "delay", "ok", "hourly", "daily", "ok", "ok", "daily"]
    assert pacing.breaker_trips([(t, True) for t in range(5)], pacing.Breaker()) == [(4, "run", False)]
    mixed = [(t, t % 4 == 0) for t in range(20)]
    assert pacing.breaker_trips(mixed, pacing.Breaker()) == [(19, "rate", False)]
    twice = [(t, True) for t in range(5)] + [(13 * 3600 + t, True) for t in range(5)]
    assert pacing.breaker_trips(twice, pacing.Breaker())[-1][2] is True


def test_the_breaker_stands_first_in_the_ladder():
    gate = pacing.Gate(pacing.Budget(min_delay=0, per_hour=10**6, per_day=10**6), pacing.Breaker())
    hour = 3600.0
    assert [gate.ask(t, "HOT", True) for t in range(7)] == ["ok"] * 5 + ["breaker_open"] * 2
    # What is turned away is not fetched and counts for nothing; blocked fetches after the cooldown trip again.
    assert [gate.ask(12 * hour + 4 + t, "HOT", True) for t in range(7)] == ["ok"] * 5 + ["disabled"] * 2
    far = pacing.Gate(pacing.Budget(min_delay=0, per_hour=10**6, per_day=10**6), pacing.Breaker())
    days = [far.ask(d * 60 * hour + t, "HOT", True) for d in range(3) for t in range(6)]
    assert days == (["ok"] * 5 + ["breaker_open"]) * 3


def test_gated_rows(spark):
    rows = [(r, k, START + timedelta(seconds=20 * k), "HOT", None if k % 2 else True) for r in (1, None) for k in range(4)] + [(1, 9, None, "HOT", True)]
    frame = spark.createDataFrame(rows, "retailer_id long, seq long, at timestamp, kind string, blocked boolean")
    got = pacing.admit_requests(frame, pacing.Budget(min_delay=30)).collect()
    assert sorted((r.retailer_id or 0, r.seq, r.verdict) for r in got) == [(i, k, "delay" if k % 2 else "ok") for i in (0, 1) for k in range(4)]
    assert pacing.admit_requests(frame.limit(0)).count() == 0


def test_breaker_frame(spark):
    rows = [(1, k, START + timedelta(seconds=k), True) for k in range(5)] + [(2, 9, START, False)]
    got = pacing.breaker_events(spark.createDataFrame(rows, "retailer_id long, seq long, at timestamp, blocked boolean")).collect()
    assert [(r.retailer_id, r.cause) for r in got] == [(1, "run")]
