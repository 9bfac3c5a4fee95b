"""Micro-batch ticks: landed observations arrive bare, get their context from keyed state, are judged
and stored.

The context is what the guards compare with: how many variants and prices the page showed in this
sweep and the one before, and the offer's last OK price. Both live in typed state that goes from
batch to batch, so nothing that is stored has to be read again.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..config import RULES, Rules
from ..operators.guards import judged, next_ok, sound
from ..operators.sweeps import COUNTS
from .shipping import by_value, held, kept

#: Bare observations. ``sweep`` orders a page's passes; rows of a sweep may come in several batches.
BARE = (
    "offer_id long, seq string, observed_at timestamp, snapshot_ref string, page_key string, sweep long, variant_key string, listing_variant_key string, price_cents long, currency string, band_floor long, "
    "band_ceiling long, on_clearance boolean, claimed_cents long, unit_count long, listing_unit_count long, condition string, wording string, used_page boolean"
)
NAMES = [c.strip().split(" ")[0] for c in BARE.split(",")]
_COUNTED = f"{BARE}, {', '.join(f'{c} long' for c in COUNTS)}"
_WITH_LAST = f"{_COUNTED}, sound boolean, last_price long"


def _typed(frame: pd.DataFrame, schema: str) -> pd.DataFrame:
    """Whole numbers and truth values in types that know nulls; pandas turns them into floats otherwise."""
    kinds = dict(c.strip().split(" ") for c in schema.split(","))
    return frame.astype({n: {"long": "Int64", "boolean": "boolean"}[k] for n, k in kinds.items() if k in ("long", "boolean") and n in frame})


class SweepCounts(StatefulProcessor):
    """Adds the counts of a page's sweep and of the one before; one page a key.

    ``sweeps`` (value) has the sweep that is going on and the counts of the one before; ``variants``
    and ``prices`` (lists) what the present one has shown so far.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sweeps = handle.getValueState("sweeps", "sweep long, variants long, prices long")
        self.shown = {c: handle.getListState(c, "names array<string>, n array<long>") for c in ("variants", "prices")}

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = _typed(pd.concat(list(rows))[NAMES], BARE)
        alone = frame["page_key"].isna() | frame["sweep"].isna()
        if alone.any():
            yield frame[alone].assign(**{c: pd.array([None] * int(alone.sum()), dtype="Int64") for c in COUNTS})
        if alone.all():
            return
        present, *before = self.sweeps.get() or (None, None, None)
        stored = {c: set(held(state)) for c, state in self.shown.items()}
        known = {c: set(names) for c, names in stored.items()}
        for sweep, part in frame[~alone].sort_values("sweep").groupby("sweep"):
            if sweep != present:
                if present is not None:
                    before = [len(known["variants"]), len(known["prices"])]
                present, known = int(sweep), {"variants": set(), "prices": set()}
            known["variants"] |= set(part["variant_key"].dropna())
            known["prices"] |= {str(p) for p in part["price_cents"].dropna()}
            values = [len(known["variants"]), len(known["prices"]), *before]
            yield part.assign(**{c: pd.array([v] * len(part), dtype="Int64") for c, v in zip(COUNTS, values)})
        self.sweeps.update((present, *before))
        for c, state in self.shown.items():
            kept(state, dict.fromkeys(stored[c], 1), dict.fromkeys(sorted(known[c]), 1))

    def close(self) -> None:
        return None


class LastOk(StatefulProcessor):
    """Drops replayed snapshots and adds the offer's last OK price; one offer a key.

    ``last`` (value) is that price; ``seen`` (list) the snapshots taken, with their times. With
    ``replay_hours`` they are forgotten that long after, by the time of the observations: a time to
    live of Spark's would need timers of the processor's clock, with which a run over all that is
    there never ends. Rows without a snapshot are never replays. Rows of a batch are taken in order
    of time, batches as they come.
    """

    def __init__(self, rules: Rules, replay_hours: int | None):
        self.rules, self.replay = rules, None if replay_hours is None else pd.Timedelta(hours=replay_hours)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "price long")
        self.seen = handle.getListState("seen", "refs array<string>, taken array<long>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # Whole numbers with nulls have come as floats and go back as they are; an offer has few rows, so plain lists are quicker.
        frame = pd.concat(list(rows)).drop(columns="offer")
        before = self.last.get()
        last = before[0] if before else None
        known = held(self.seen)
        seen = dict(known)
        places, prices = [], []
        refs, seqs, sounds = (frame[c].tolist() for c in ("snapshot_ref", "seq", "sound"))
        times = [None if pd.isna(at) else at.value for at in frame["observed_at"].tolist()]
        price, count, listed = ([None if v is None or v != v else int(v) for v in frame[c].tolist()] for c in ("price_cents", "unit_count", "listing_unit_count"))
        for k in sorted(range(len(times)), key=lambda k: (times[k] is None, times[k] or 0, not isinstance(seqs[k], str), seqs[k] if isinstance(seqs[k], str) else "")):
            ref, at = refs[k], times[k]
            named = isinstance(ref, str) and ref != ""
            taken = seen.get(ref) if named else None
            if not (taken is None or self.replay is not None and at is not None and at - taken > self.replay.value):
                continue
            if named:
                seen[ref] = at or 0
            places.append(k)
            prices.append(last)
            last = next_ok(price[k], last, bool(sounds[k]), count[k], listed[k], self.rules)
        newest = max((at for at in times if at is not None), default=None)
        if self.replay is not None and newest is not None:
            seen = {ref: taken for ref, taken in seen.items() if taken >= newest - self.replay.value}
        kept(self.seen, known, seen)
        if last is not None and (before is None or last != before[0]):
            self.last.update((int(last),))
        if prices:
            yield frame.take(places).assign(last_price=pd.array(prices, dtype="Int64"))

    def close(self) -> None:
        return None


def judged_stream(stream: DataFrame, rules: Rules = RULES, replay_hours: int | None = RULES.replay_hours) -> DataFrame:
    """A stream of bare observations (BARE) with context, quality and reasons. The session must use
    the store ``deals.STATE_STORE``.

    Rows without a page or a sweep have no counts, rows without an offer are one offer. A row that
    repeats an offer's snapshot within ``replay_hours`` (None: ever) is dropped.
    """
    # Rows without a page are dealt by offer, so that they are no group of their own.
    page = F.coalesce(F.concat(F.lit("p"), F.col("page_key")), F.concat(F.lit("o"), F.coalesce(F.col("offer_id").cast("string"), F.lit(""))))
    with by_value():
        counted = stream.select(page.alias("page"), *NAMES).groupBy("page").transformWithStateInPandas(SweepCounts(), _COUNTED, "Append", "None")
    ready = counted.withColumn("sound", F.coalesce(sound(counted, rules), F.lit(False)))
    # A null is no key that state could be kept under.
    keyed = ready.withColumn("offer", F.coalesce(F.col("offer_id").cast("string"), F.lit("")))
    with by_value():
        lasted = keyed.groupBy("offer").transformWithStateInPandas(LastOk(rules, replay_hours), _WITH_LAST, "Append", "None")
    return judged(lasted.drop("sound"), rules)


def store_batch(batch: DataFrame, batch_id: int, store: str) -> None:
    """Stores a batch of judged rows by quality and day, under its own number.

    A batch that runs again after a lost driver writes over its own rows and no others, so rows
    are stored once whether or not they name a snapshot. A store belongs to one checkpoint.
    """
    batch.withColumn("observed_date", F.to_date("observed_at")).write.mode("overwrite").partitionBy("quality", "observed_date").parquet(f"{store}/batch={batch_id}")


def stored(spark, store: str) -> DataFrame:
    """All rows of a store."""
    return spark.read.option("basePath", store).parquet(f"{store}/batch=*")


def start_ticks(stream: DataFrame, store: str, checkpoint: str, every: str | None = None, rules: Rules = RULES, replay_hours: int | None = RULES.replay_hours) -> StreamingQuery:
    """Runs a tick every interval, or once over all that is there."""
    writer = judged_stream(stream, rules, replay_hours).writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(lambda batch, n: store_batch(batch, n, store))
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start()
