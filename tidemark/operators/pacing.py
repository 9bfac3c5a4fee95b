"""Order-dependent folds of the fetcher: rate limit, admission and circuit breaker."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass
class Budget:
    min_delay: float = 10.0
    per_hour: int = 90
    per_day: int = 1200
    reserved: float = 0.30


@dataclass
class Breaker:
    run: int = 5
    rate: float = 0.20
    sample: int = 20
    cooldown: float = 12 * 3600.0
    trips: int = 2
    span: float = 48 * 3600.0


class Circuit:
    """A retailer's breaker: outcomes go in, trips come out."""

    def __init__(self, b: Breaker):
        self.b, self.row, self.recent = b, 0, deque(maxlen=b.sample)
        self.open_until: float | None = None
        self.trips: list[float] = []
        self.disabled = False

    def open(self, t: float) -> bool:
        return self.open_until is not None and t < self.open_until

    def record(self, t: float, blocked: bool) -> str | None:
        """The cause if this outcome trips the breaker. Outcomes count while it is open, but trip nothing."""
        b = self.b
        self.row = self.row + 1 if blocked else 0
        self.recent.append(bool(blocked))
        cause = "run" if self.row >= b.run else "rate" if len(self.recent) >= b.sample and sum(self.recent) / len(self.recent) > b.rate else None
        if cause is None or self.open(t):
            return None
        self.open_until, self.row = t + b.cooldown, 0
        self.trips = [x for x in self.trips if t - x < b.span] + [t]
        self.disabled = self.disabled or len(self.trips) >= b.trips
        return cause


def breaker_trips(outcomes: Iterable[tuple[float, bool]], b: Breaker) -> list[tuple[float, str, bool]]:
    """(time, cause, disabled) of every trip for (time, blocked) fetches."""
    circuit = Circuit(b)
    found = ((t, circuit.record(t, blocked)) for t, blocked in outcomes)
    return [(t, cause, circuit.disabled) for t, cause in found if cause]


class Gate:
    """A retailer's whole ladder: disabled, breaker_open, delay, hourly, daily, else ok.

    What is let through is fetched, and its outcome feeds the breaker that stands first in the ladder.
    """

    def __init__(self, budget: Budget, b: Breaker):
        self.budget, self.circuit = budget, Circuit(b)
        self.last = self.hour = self.day = None
        self.in_hour = self.in_day = 0

    def ask(self, t: float, kind: str | None, blocked: bool) -> str:
        """The verdict on a request; ``blocked`` is what its fetch would meet."""
        if self.hour is None or t - self.hour >= 3600:
            self.hour, self.in_hour = t, 0
        if self.day is None or t - self.day >= 86400:
            self.day, self.in_day = t, 0
        budget = self.budget
        cap = budget.per_day if kind in ("CONFIRM", "HOT") else budget.per_day * (1 - budget.reserved)
        if self.circuit.disabled:
            return "disabled"
        if self.circuit.open(t):
            return "breaker_open"
        if self.last is not None and t - self.last < budget.min_delay:
            return "delay"
        if self.in_hour >= budget.per_hour:
            return "hourly"
        if self.in_day >= cap:
            return "daily"
        self.last, self.in_hour, self.in_day = t, self.in_hour + 1, self.in_day + 1
        self.circuit.record(t, blocked)
        return "ok"


class Window60:
    """A client's sliding window of admitted requests."""

    def __init__(self, limit: int, window: float):
        self.limit, self.window, self.kept = limit, window, deque()

    def ask(self, t: float) -> bool:
        while self.kept and self.kept[0] <= t - self.window:
            self.kept.popleft()
        if len(self.kept) >= self.limit:
            return False
        self.kept.append(t)
        return True


def _folded(rows: DataFrame, key: str, fields: list[str], start: Callable[[], Callable[[float, tuple], tuple | None]], added: list[tuple[str, pa.DataType, str]]) -> DataFrame:
    """``rows`` (key, seq, at and ``fields``) of every key in order of time through a step of its own.

    The step gets a row's seconds and fields and gives the values of the columns ``added``, or None
    for no row. A key's rows stream through one task; only what the step holds is kept. Rows
    without a time have no place and are left out; rows without a key are one key.
    """
    taken = rows.select(key, "seq", "at", *fields).where(F.col("at").isNotNull()).withColumn("seconds", F.unix_micros("at") / 1_000_000).repartition(key).sortWithinPartitions(key, "at", "seq")
    types = T.StructType([*taken.drop("seconds").schema.fields, *[T.StructField(n, T._parse_datatype_string(d)) for n, _, d in added]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        present, begun, step = None, False, None
        for batch in batches:
            told = []
            for who, seconds, *values in zip(*[batch.column(c).to_pylist() for c in (key, "seconds", *fields)]):
                if not begun or who != present:
                    present, begun, step = who, True, start()
                told.append(step(seconds, tuple(values)))
            kept = batch.filter(pa.array([x is not None for x in told], pa.bool_())).drop_columns(["seconds"])
            columns = zip(*[x for x in told if x is not None]) if kept.num_rows else [()] * len(added)
            yield pa.RecordBatch.from_arrays([*kept.columns, *[pa.array(list(c), t) for c, (_, t, _) in zip(columns, added)]], [*kept.schema.names, *[n for n, _, _ in added]])

    return taken.mapInArrow(run, types)


def limit_requests(requests: DataFrame, limit: int = 30, window: float = 60.0) -> DataFrame:
    """(client, seq, at) with ``admitted``."""

    def start():
        held = Window60(limit, window)
        return lambda t, _: (held.ask(t),)

    return _folded(requests, "client", [], start, [("admitted", pa.bool_(), "boolean")])


def breaker_events(fetches: DataFrame, b: Breaker = Breaker()) -> DataFrame:  # noqa: B008
    """(retailer_id, at, cause, disabled) of every trip from (retailer_id, seq, at, blocked)."""

    def start():
        circuit = Circuit(b)

        def step(t: float, values: tuple) -> tuple | None:
            cause = circuit.record(t, values[0])
            return (cause, circuit.disabled) if cause else None

        return step

    return _folded(fetches, "retailer_id", ["blocked"], start, [("cause", pa.string(), "string"), ("disabled", pa.bool_(), "boolean")]).select("retailer_id", "at", "cause", "disabled")


def admit_requests(requests: DataFrame, budget: Budget = Budget(), b: Breaker = Breaker()) -> DataFrame:  # noqa: B008
    """(retailer_id, seq, at, kind, blocked) with ``verdict``, the first rung of the ladder that holds.

    ``blocked`` is what a request meets if it is let through; a null counts as not blocked.
    """

    def start():
        gate = Gate(budget, b)
        return lambda t, values: (gate.ask(t, *values),)

    return _folded(requests, "retailer_id", ["kind", "blocked"], start, [("verdict", pa.string(), "string")])
