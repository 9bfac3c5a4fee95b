"""Streaming twins: the deal machine, replay dedupe and the hourly health rollup."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..config import RULES, Rules
from ..operators.deal_machine import DEAL, TAKEN, TAKEN_NAMES, TOLD, TOLD_NAMES, Deal, Machine, OfferState, shown
from .shipping import by_value, held, kept

#: The store that keeps typed state; a session names it before the stream starts.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
#: Many rows of TAKEN as one, an array for each column.
_PACKED = ", ".join("{} array<{}>".format(*c.strip().split(" ")) for c in TAKEN.split(","))
_WHOLE = {c.strip().split(" ")[0] for c in TAKEN.split(",") if c.strip().endswith(" long")}


def _rows(frame: pd.DataFrame) -> list[tuple]:
    """Rows of TAKEN as plain values, missing ones as None."""
    # What is missing is None or differs from itself.
    columns = [[None if v is None or v != v else int(v) if n in _WHOLE else bool(v) if n == "on_clearance" else v for v in frame[n].tolist()] for n in TAKEN_NAMES]
    return list(zip(*columns))


class DealProcessor(StatefulProcessor):
    """The deal machine over keyed state, one offer a key.

    ``waiting`` (list, a row for each batch) is the reorder buffer: observations stay there until the watermark has passed
    them, so that they are taken in order however they arrive. ``deals`` (list) has the open deals
    by rule, ``seen`` (list) the snapshots taken, ``clock`` (value) the last sound observation and
    the timer that is set. One timer stands at the next thing to happen, be it
    a waiting observation or one of the deals' own timers.

    Spark's own time to live of state goes by the processor's clock and is refused beside event
    timers; snapshots are forgotten by the observations' time instead, as in the batch fold.
    """

    def __init__(self, rules: Rules, used_reference: bool):
        self.rules, self.used_reference = rules, used_reference

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _PACKED)
        self.deals = handle.getListState("deals", f"rule string, {DEAL}")
        self.seen = handle.getListState("seen", "refs array<string>, taken array<long>")
        self.clock = handle.getValueState("clock", "last_ok long, timer long")

    def _set_timer(self, due: int | None, clock: tuple) -> None:
        """Moves the key's timer to ``due`` (microseconds) and keeps the clock."""
        last_ok, timer = clock
        at = None if due is None else due // 1000
        if timer is not None and timer != at:
            self.handle.deleteTimer(timer)
        if at is not None and timer != at:
            self.handle.registerTimer(at)
        self.clock.update((last_ok, at))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        found = [r for frame in rows for r in _rows(frame)]
        self.waiting.appendValue(tuple(map(list, zip(*found))))
        last_ok, timer = self.clock.get() or (None, None)
        first = min(r[TAKEN_NAMES.index("at")] for r in found)
        if timer is None or first // 1000 < timer:
            self._set_timer(first, (last_ok, timer))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = timerValues.getCurrentWatermarkInMs() * 1000
        last_ok, _ = self.clock.get()
        at, seq = TAKEN_NAMES.index("at"), TAKEN_NAMES.index("seq")
        waiting = sorted((r for packed in self.waiting.get() for r in zip(*packed)), key=lambda r: (r[at], r[seq] is not None, r[seq] or ""))
        ready = [r for r in waiting if r[at] < until]
        known = held(self.seen) if ready else {}
        deals = [tuple(r) for r in self.deals.get()]
        state = OfferState({rule: Deal(*deal) for rule, *deal in deals}, last_ok, dict(sorted(known.items(), key=lambda x: x[1])))
        machine = Machine(int(key[0]) if key[0] else None, state, self.rules, self.used_reference)
        events = []
        for row in ready:
            events += machine.take(dict(zip(TAKEN_NAMES, row)))
        events += machine.pass_time(until)
        if (open_deals := [(rule, *deal.plain()) for rule, deal in state.deals.items()]) != deals:
            self.deals.put(open_deals) if open_deals else self.deals.clear()
        if ready:
            kept(self.seen, known, state.seen)
            left = waiting[len(ready) :]
            self.waiting.put([tuple(map(list, zip(*left)))]) if left else self.waiting.clear()
        due = [t for t, _, _ in machine.timers()] + [r[at] for r in waiting[len(ready) :][:1]]
        # The timer that fired is gone.
        self._set_timer(min(due, default=None), (state.last_ok, None))
        if events:
            frame = pd.DataFrame(events, columns=TOLD_NAMES)
            for n in ("offer_id", "at", "price_cents", "reference_cents", "discount_bp"):
                frame[n] = frame[n].astype("Int64")
            yield frame

    def close(self) -> None:
        return None


def deal_event_stream(observations: DataFrame, late: str = "1 hour", rules: Rules = RULES, used_reference: bool = False) -> DataFrame:
    """The events of ``deal_events``, from a stream of the same rows that arrive in any order within ``late``.

    What is emitted is what the batch fold gives ``until`` the watermark; a row that comes later
    than ``late`` is dropped by the watermark. The session must use the store STATE_STORE.
    """
    rows = observations.where(F.col("observed_at").isNotNull()).withWatermark("observed_at", late).withColumn("at", F.unix_micros("observed_at"))
    # A null is no key that state could be kept under, so offers are keyed by their number as text.
    keyed = rows.select(F.coalesce(F.col("offer_id").cast("string"), F.lit("")).alias("offer"), "observed_at", *TAKEN_NAMES)
    processor = DealProcessor(rules, used_reference)
    with by_value():
        return shown(keyed.groupBy("offer").transformWithStateInPandas(processor, TOLD, "Append", "EventTime"))


def first_snapshots(observations: DataFrame, late: str | None = None) -> DataFrame:
    """Each (offer_id, snapshot_ref) once; with ``late`` the memory of keys is bounded by a watermark."""
    keys = ["offer_id", "snapshot_ref"]
    if late is None:
        return observations.dropDuplicates(keys)
    return observations.withWatermark("observed_at", late).dropDuplicatesWithinWatermark(keys)


def hourly_health(fetches: DataFrame, late: str = "1 hour") -> DataFrame:
    """Fetches, blocks and successes of each retailer and hour, emitted once the hour is over."""
    windowed = fetches.withWatermark("at", late).groupBy(F.window("at", "1 hour"), "retailer_id")
    return windowed.agg(F.count("*").alias("fetched"), F.count_if("blocked").alias("blocked")).select(F.col("window.start").alias("hour"), "retailer_id", "fetched", "blocked")
