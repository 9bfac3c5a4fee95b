"""Ticks: context from keyed state, replays, storing once; sweeps and the fold of the last OK price."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.config import RULES
from tidemark.operators import guards, sweeps
from tidemark.streaming.deals import STATE_STORE
from tidemark.streaming.shipping import held, kept
from tidemark.streaming.ticks import BARE, NAMES, start_ticks, store_batch, stored

START = datetime(2024, 5, 1)


def bare(k, minutes, price, **other):
    base = {"offer_id": 1, "seq": f"{k:04d}", "observed_at": START + timedelta(minutes=minutes), "snapshot_ref": f"s{k}", "page_key": "p", "sweep": minutes // 60, "variant_key": "v", "price_cents": price, "currency": "USD", "band_floor": 100, "band_ceiling": 100000, "on_clearance": False, "condition": "NEW", "wording": "new", "used_page": False, "unit_count": 1, "listing_unit_count": 1}
    return tuple((base | other).get(n) for n in NAMES)


@pytest.fixture()
def state_store(spark):
    spark.conf.set(*STATE_STORE)
    yield
    spark.conf.unset(STATE_STORE[0])


def shown(rows):
    names = ("offer_id", "seq", *sweeps.COUNTS, "last_price", "quality", "quality_reasons")
    return sorted((tuple(map(str, (r[n] for n in names))) for r in rows.select(*names).collect()))


def run(spark, tmp_path, parts, **options):
    for part in parts:
        spark.createDataFrame(part, BARE).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(BARE).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    start_ticks(stream, str(tmp_path / "store"), str(tmp_path / "ck"), **options).awaitTermination()
    return stored(spark, str(tmp_path / "store"))


def test_state_goes_from_batch_to_batch(spark, tmp_path, state_store):
    """Bare rows in many batches are judged as they are in one go, for sweeps that end with their batch."""
    rng = random.Random(4)
    parts = [[bare(100 * b + k, 60 * b + k, rng.choice([1000, 1100, 200, 5000, 0, None]), offer_id=rng.choice([1, 2, 3, None]), page_key=rng.choice(["p", "q", None]), variant_key=f"v{rng.randrange(2 if b == 3 else 12)}", snapshot_ref=rng.choice([None, "", f"x{b}{k}"])) for k in range(30)] for b in range(5)]
    got = run(spark, tmp_path, parts)
    whole = spark.createDataFrame([r for p in parts for r in p], BARE)
    expected = guards.judged(guards.with_last_ok(sweeps.with_sweep_counts(whole)))
    assert shown(got) == shown(expected) and got.count() == 150
    assert {x for r in got.select("quality_reasons").collect() for x in r[0]} >= {"large_move", "variant_collapse", "out_of_band"} - {"out_of_band"}
    # Later ticks of the same stream go on; a rerun without new rows adds nothing.
    assert run(spark, tmp_path, []).count() == 150
    more = run(spark, tmp_path, [[bare(900, 400, 1000, offer_id=9, sweep=9)]])
    assert more.count() == 151 and [(r.previous_variants is not None) for r in more.where("offer_id = 9").collect()] == [True]


def test_replays_are_dropped_for_a_time_and_rows_without_snapshot_never(spark, tmp_path, state_store):
    parts = [[bare(1, 0, 1000, snapshot_ref="a"), bare(2, 1, 1000, snapshot_ref="a"), bare(3, 2, 1000, snapshot_ref=""), bare(4, 3, 1000, snapshot_ref=None)], [bare(5, 5, 1000, snapshot_ref="a"), bare(6, 6, 1000, snapshot_ref="")], [bare(7, 200, 1000, snapshot_ref="a")]]
    got = run(spark, tmp_path, parts, replay_hours=2)
    assert sorted(r.seq for r in got.select("seq").collect()) == ["0001", "0003", "0004", "0006", "0007"]


def test_a_batch_that_runs_twice_is_stored_once(spark, tmp_path):
    rows = spark.createDataFrame([bare(k, k, 1000 + k, snapshot_ref=None if k % 2 else "") for k in range(6)], BARE)
    made = guards.judged(guards.with_last_ok(sweeps.with_sweep_counts(rows)))
    for n in (0, 1, 1, 0):
        store_batch(made.where(F.col("seq") % 2 == n), n, str(tmp_path / "s"))
    assert stored(spark, str(tmp_path / "s")).count() == 6


def test_sessions_of_fetches(spark):
    at = [0, 10, 20, 100, 105, 300]
    rows = [("p", START + timedelta(seconds=s), f"v{k % 3}", 5 * (k % 2)) for s in at for k in range(4)] + [("q", START, "x", 1), (None, START, "y", 1), ("p", None, "z", 1)]
    frame = spark.createDataFrame(rows, "page_key string, observed_at timestamp, variant_key string, price_cents long")
    got = {(r.page_key, (r.observed_at - START).total_seconds()): r.sweep for r in sweeps.sessions(frame, 50).collect()}
    assert got == {("p", 0): 1, ("p", 10): 1, ("p", 20): 1, ("p", 100): 2, ("p", 105): 2, ("p", 300): 3, ("q", 0): 1}
    full = sweeps.with_sweep_counts(frame, 50)
    assert full.count() == len(rows)
    assert {(r.sweep, r.variants, r.prices, r.previous_variants, r.previous_prices) for r in full.where("page_key = 'p'").collect()} == {(1, 3, 2, None, None), (2, 3, 2, 3, 2), (3, 3, 2, 3, 2), (None, None, None, None, None)}
    assert sweeps.with_sweep_counts(frame.limit(0), 50).count() == 0


def test_plain_guards_equal_the_columns(spark):
    numbers = [None, 0, 1, 2, 3, 4, 10, 12]
    rows = [(p, last, c, n) for p in (1, 50, 100, 250, 333, 500, 1000, 1200, 3001) for last in (None, 0, 100, 1000) for c in numbers for n in numbers]
    frame = spark.createDataFrame(rows, "p long, l long, c long, n long")
    got = frame.select(guards.move_guard(F.col("p"), F.col("l")).alias("m"), guards.pack_guard(*map(F.col, "plcn")).alias("k")).collect()
    assert [(r.m, r.k) for r in got] == [(guards.moved(p, last, RULES), guards.packed(p, last, c, n, RULES)) for p, last, c, n in rows]


@pytest.mark.parametrize("few", [None, 0])
def test_sweeps_are_looked_up_without_shuffling_rows(spark, monkeypatch, few):
    """Fetch times are few beside rows, so rows stay where they are; if they are not few, the result is the same."""
    rng = random.Random(8)
    rows = [(rng.choice(["p", "q", None]), START + timedelta(hours=rng.choice([1, 2, 3, 30, 31, 60])) if k % 9 else None, f"v{rng.randrange(6)}", rng.randrange(4), f"s{k}") for k in range(200)]
    frame = spark.createDataFrame(rows, "page_key string, observed_at timestamp, variant_key string, price_cents long, seq string")
    expected = sweeps.with_sweep_counts(frame, 86_400)
    told = lambda df: sorted(map(str, df.select("seq", "sweep", *sweeps.COUNTS).collect()))
    wanted = told(expected)
    if few is not None:
        monkeypatch.setattr(sweeps, "FEW", few)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = sweeps.with_sweep_counts(frame, 86_400)
        named = sweeps.with_sweep_counts(found.drop(*sweeps.COUNTS))
        plans = [df._jdf.queryExecution().executedPlan().toString() for df in (found.select("seq", *sweeps.COUNTS), named.select("seq", *sweeps.COUNTS))]
        carried = [sum("Exchange hashpartitioning(page_key" in line and "seq" in "".join(plan.splitlines()[k : k + 2]) for k, line in enumerate(plan.splitlines())) for plan in plans]
        assert told(found) == wanted and told(named) == wanted and len(wanted) == 200
        assert (carried == [0, 0]) == (few is None) and carried[0] <= 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_batch_adds_one_row_of_state_in_one_call():
    """However many snapshots a batch brings: every row of state and every call is a way to the store and back."""

    class State:
        def __init__(self):
            self.rows, self.calls = [], 0

        def get(self):
            return iter(self.rows)

        def put(self, rows):
            self.rows, self.calls = list(rows), self.calls + 1

        def appendValue(self, row):
            self.rows, self.calls = [*self.rows, row], self.calls + 1

        def clear(self):
            self.rows, self.calls = [], self.calls + 1

    state, was = State(), {}
    first = {f"s{k}": k for k in range(500)}
    steps = [first, first | {"s7": 900, "t": 901}, first | {"s7": 900, "t": 901}, {"t": 901}, {}]
    for now, calls, rows in zip(steps, (1, 2, 2, 3, 4), (1, 2, 2, 1, 0)):
        kept(state, was, now)
        was = held(state)
        assert was == now and (state.calls, len(state.rows)) == (calls, rows)
