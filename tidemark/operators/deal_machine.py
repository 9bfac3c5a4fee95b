"""The deal state machine of an offer, used by the batch fold and by the stream.

It takes an offer's observations in time order, with the references known at their time. For each
one, in order: timers that ran out before it fire; a replayed snapshot is skipped; an active deal is
rechecked; else an open one is confirmed (checks C1 to C10); else a new one is detected.

Three timers belong to a deal, all in the time of the observations: ten minutes after detection its
confirmation is due, three hours after detection it is rejected, and 24 hours after the offer's last
sound observation an active deal expires. A timer fires when time has passed it, and its event bears
the timer's time.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import RULES, USED_RULE_CONDITIONS, Rules

NEW, CLAIMED, USED = "DEEP_DISCOUNT_NEW", "DEEP_DISCOUNT_CLAIMED", "USED_VS_CURRENT_NEW"
ORDER = (NEW, CLAIMED, USED)
BUYABLE = ("IN_STOCK", "STORE_ONLY")
#: Observations as they arrive. other_reason is the first reason of a SUSPECT that is not large_move; identity stands for
#: retailer's number, offer key, condition and seller; reference_key and reference_units are the reference offer's own.
INPUT = (
    "offer_id long, seq string, observed_at timestamp, snapshot_ref string, quality string, other_reason string, detected_via string, page_type string, identity string, "
    "condition string, condition_group string, availability string, on_clearance boolean, price_cents long, shipping_cents long, claimed_cents long, verified_cents long, current_new_cents long, "
    "reference_key string, reference_units long, variant_key string, unit_count long, listing_key string, listing_units long, floor_cents long"
)
NAMES = [c.strip().split(" ")[0] for c in INPUT.split(",")]
#: The same with instants as microseconds, which no session's time zone touches.
TAKEN = INPUT.replace("observed_at timestamp", "at long")
TAKEN_NAMES = ["at" if n == "observed_at" else n for n in NAMES]
TOLD = "offer_id long, seq string, at long, rule string, event string, status string, reason string, price_cents long, reference_cents long, discount_bp long"
TOLD_NAMES = [c.strip().split(" ")[0] for c in TOLD.split(",")]
DEAL = "status string, seq string, at long, price long, reference long, key string, units long, via string, identity string, told boolean"
_MINUTE, _HOUR = 60_000_000, 3_600_000_000


@dataclass
class Deal:
    """An open deal; its fields are ``DEAL``. ``told``: that its confirmation is due was told."""

    status: str
    seq: str
    at: int
    price: int
    reference: int
    key: str | None
    units: int | None
    via: str | None
    identity: str | None
    told: bool = False

    def plain(self) -> tuple:
        return (self.status, self.seq, self.at, self.price, self.reference, self.key, self.units, self.via, self.identity, self.told)


@dataclass
class OfferState:
    """What is known of an offer: open deals by rule, the last sound observation, snapshots taken."""

    deals: dict[str, Deal] = field(default_factory=dict)
    last_ok: int | None = None
    seen: dict[str, int] = field(default_factory=dict)


def basis_points(price: int, reference: int | None) -> int:
    if not reference or reference <= 0:
        return 0
    return int((reference - price) * 10000.0 / reference + 0.5) if price <= reference else -int((price - reference) * 10000.0 / reference + 0.5)


def _deep(price: int, reference: int | None, rules: Rules) -> bool:
    return reference is not None and reference - price >= rules.min_saving_cents and basis_points(price, reference) >= rules.min_discount_bp


def _landed(row: dict) -> int:
    return row["price_cents"] + (row["shipping_cents"] or 0)


def detect(row: dict, rules: Rules) -> tuple[str, int, int] | None:
    """(rule, price, reference) of the first rule that an OK observation fulfils."""
    price, condition = row["price_cents"], row["condition"]
    if row["condition_group"] in ("NEW", None) and condition == "NEW":
        if row["availability"] in BUYABLE and _deep(price, row["verified_cents"], rules):
            return NEW, price, row["verified_cents"]
        if row["verified_cents"] is None and row["on_clearance"] and _deep(price, row["claimed_cents"], rules):
            return CLAIMED, price, row["claimed_cents"]
    elif condition in USED_RULE_CONDITIONS and row["availability"] == "IN_STOCK" and _deep(_landed(row), row["current_new_cents"], rules):
        return USED, _landed(row), row["current_new_cents"]
    return None


def _reference(rule: str, row: dict) -> int | None:
    if rule == USED:
        return row["current_new_cents"]
    if rule == CLAIMED and row["verified_cents"] is None:
        return row["claimed_cents"] or None
    return row["verified_cents"]


def confirm(rule: str, deal: Deal, row: dict, rules: Rules = RULES, used_reference: bool = False) -> tuple[str, str | None]:
    """(status, reason) of an observation that confirms or rejects a deal: the first check that fails.

    ``used_reference`` lets used goods be confirmed against a reference for new ones, which
    the check of condition groups otherwise rejects.
    """
    price, reference = row["price_cents"], _reference(rule, row)
    bp = basis_points(price, reference)
    group = row["condition_group"] or ("NEW" if row["condition"] == "NEW" else "USED")
    if row["at"] - deal.at < rules.min_confirm_minutes * _MINUTE:
        return "REJECTED", "confirm_too_soon"
    if deal.via == "DISCOVERY_GRID" and row["page_type"] != "PRODUCT":
        return "REJECTED", "confirm_not_from_product_page"
    if deal.identity != row["identity"]:
        return "REJECTED", "offer_identity_mismatch"
    if len({deal.key, row["variant_key"], row["listing_key"]}) > 1 or len({deal.units, row["unit_count"], row["listing_units"]}) > 1:
        return "REJECTED", "variant_mismatch"
    if row["quality"] == "REJECTED":
        return "REJECTED", "quality:rejected"
    if row["quality"] == "SUSPECT" and row["other_reason"]:
        return "REJECTED", f"quality:{row['other_reason']}"
    if price > deal.price * rules.price_tolerance:
        return "REJECTED", "price_changed"
    if bp < rules.min_discount_bp:
        return "REJECTED", "below_threshold_on_confirm"
    key, units = row["variant_key"] or row["listing_key"], row["listing_units"] if row["unit_count"] is None else row["unit_count"]
    scope = [(row["reference_key"], key), (row["reference_units"], units)]
    if any(x is not None and y is not None and x != y for x, y in scope) or group != "NEW" and not used_reference:
        return "REJECTED", "reference_scope_mismatch"
    if row["floor_cents"] is not None and price < row["floor_cents"]:
        return "REJECTED", "below_floor"
    if bp > rules.implausible_bp:
        return "REJECTED", "implausible_discount"
    return ("HELD_REVIEW", "discount_85_to_95") if bp > rules.held_upper_bp else ("ACTIVE", None)


class Machine:
    """An offer's state and what happens to it. Times are microseconds."""

    def __init__(self, offer_id, state: OfferState, rules: Rules = RULES, used_reference: bool = False):
        self.offer_id, self.state, self.rules, self.used_reference = offer_id, state, rules, used_reference
        self.gap, self.deadline, self.stale, self.replay = rules.min_confirm_minutes * _MINUTE, rules.confirm_deadline_hours * _HOUR, rules.stale_hours * _HOUR, rules.replay_hours * _HOUR

    def _event(self, seq: str, at: int, rule: str, event: str, status: str, reason: str | None, price: int | None, reference: int | None) -> tuple:
        return self.offer_id, seq, at, rule, event, status, reason, price, reference, basis_points(price, reference) if price is not None else 0

    def timers(self) -> list[tuple[int, str, str]]:
        """(time, what, rule) of all that will happen by itself."""
        found = []
        for rule, deal in self.state.deals.items():
            if deal.status == "CONFIRMING":
                found.append((deal.at + self.deadline, "deadline", rule))
                if not deal.told:
                    found.append((deal.at + self.gap, "confirm_due", rule))
            elif deal.status == "ACTIVE" and self.state.last_ok is not None:
                found.append((self.state.last_ok + self.stale, "not_observed", rule))
        return sorted(found)

    def pass_time(self, until: int) -> Iterator[tuple]:
        """The events of timers that run out before ``until``."""
        while (due := self.timers()) and due[0][0] < until:
            at, what, rule = due[0]
            deal = self.state.deals[rule]
            if what == "confirm_due":
                deal.told = True
                yield self._event(deal.seq, at, rule, what, "CONFIRMING", None, deal.price, deal.reference)
                continue
            del self.state.deals[rule]
            status, reason = ("REJECTED", "confirm_deadline_missed") if what == "deadline" else ("EXPIRED", "not_observed")
            yield self._event(deal.seq, at, rule, "rejected" if what == "deadline" else "expired", status, reason, deal.price, deal.reference)

    def _replayed(self, row: dict) -> bool:
        """Whether the row's snapshot was taken within the time that replays are remembered; else it is noted.

        Snapshots stand in the order in which they were taken, so old ones are at the front.
        """
        seen, ref = self.state.seen, row["snapshot_ref"]
        while seen and row["at"] - (first := next(iter(seen.items())))[1] > self.replay:
            del seen[first[0]]
        if not ref:
            return False
        if ref in seen:
            return True
        seen[ref] = row["at"]
        return False

    def _recheck(self, row: dict) -> tuple | None:
        price, deals = row["price_cents"], self.state.deals
        rule = next((r for r in ORDER if r in deals and deals[r].status == "ACTIVE"), None)
        if rule is None or row["quality"] != "OK" or price is None:
            return None
        deal, current, reference = deals[rule], _landed(row) if rule == USED else price, _reference(rule, row)
        if row["availability"] not in BUYABLE:
            reason = "sold_out"
        elif reference is None or reference <= 0:
            reason = "reference_lost"
        elif current > deal.price * self.rules.price_tolerance or basis_points(current, reference) < self.rules.min_discount_bp:
            reason = "price_recovered"
        else:
            deal.price, deal.reference = current, reference
            return self._event(row["seq"], row["at"], rule, "refreshed", "ACTIVE", None, current, reference)
        del deals[rule]
        return self._event(row["seq"], row["at"], rule, "expired", "EXPIRED", reason, current, reference)

    def take(self, row: dict) -> Iterator[tuple]:
        """The events of one observation, those of the timers before it first."""
        yield from self.pass_time(row["at"])
        if self._replayed(row):
            return
        if row["quality"] == "OK":
            self.state.last_ok = row["at"]
        rechecked = self._recheck(row)
        if rechecked:
            yield rechecked
            return
        price, deals = row["price_cents"], self.state.deals
        if price is None:
            return
        for rule in ORDER:
            deal = deals.get(rule)
            if deal is None or deal.status != "CONFIRMING" or deal.seq == row["seq"]:
                continue
            status, reason = confirm(rule, deal, row, self.rules, self.used_reference)
            reference = _reference(rule, row)
            if reason == "confirm_too_soon":
                # Too early an observation leaves the deal open.
                yield self._event(row["seq"], row["at"], rule, "waiting", "CONFIRMING", reason, price, reference)
                continue
            if status == "REJECTED":
                del deals[rule]
            else:
                deal.status, deal.price, deal.reference = status, price, reference if reference is not None else deal.reference
            yield self._event(row["seq"], row["at"], rule, "rejected" if status == "REJECTED" else "confirmed", status, reason, price, reference)
            return
        found = detect(row, self.rules) if row["quality"] == "OK" else None
        if found and found[0] not in deals:
            rule, current, reference = found
            deals[rule] = Deal("CONFIRMING", row["seq"], row["at"], current, reference, row["variant_key"], row["unit_count"], row["detected_via"], row["identity"])
            yield self._event(row["seq"], row["at"], rule, "detected", "CONFIRMING", None, current, reference)


def shown(told: DataFrame) -> DataFrame:
    """Events with their time as a timestamp."""
    return told.select("offer_id", "seq", F.timestamp_micros("at").alias("observed_at"), *TOLD_NAMES[3:])


def told_batches(events: Iterable[tuple], most: int = 8192) -> Iterator[pa.RecordBatch]:
    kinds = {"long": pa.int64(), "string": pa.string()}
    schema = pa.schema([(n, kinds[c.strip().split(" ")[1]]) for n, c in zip(TOLD_NAMES, TOLD.split(","))])
    held: list[tuple] = []
    for event in events:
        held.append(event)
        if len(held) >= most:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def deal_events(observations: DataFrame, rules: Rules = RULES, used_reference: bool = False, until: int | None = None) -> DataFrame:
    """Batch fold: the events of every offer's observations (columns INPUT) in order of time and ``seq``.

    With ``until`` (microseconds) only observations before that time count, and timers run on to it;
    without it an offer's time ends with its last observation. An offer's rows are one task's work,
    since each step needs the one before, but they stream through it: only the offer's state is held.
    Rows without offer_id are one offer; rows without a time have no place in it and are left out.
    """
    rows = observations.select(*NAMES).where(F.col("observed_at").isNotNull()).withColumn("at", F.unix_micros("observed_at"))
    if until is not None:
        rows = rows.where(F.col("at") < until)
    ordered = rows.select(*TAKEN_NAMES).repartition("offer_id").sortWithinPartitions("offer_id", "at", "seq")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def events() -> Iterator[tuple]:
            machine = None
            for batch in batches:
                for row in batch.to_pylist():
                    if machine is None or machine.offer_id != row["offer_id"]:
                        if machine is not None and until is not None:
                            yield from machine.pass_time(until)
                        machine = Machine(row["offer_id"], OfferState(), rules, used_reference)
                    yield from machine.take(row)
            if machine is not None and until is not None:
                yield from machine.pass_time(until)

        yield from told_batches(events())

    return shown(ordered.mapInArrow(run, TOLD))


def deal_states(events: DataFrame) -> DataFrame:
    """One row for each deal that events (as of ``deal_events``) tell of, as it stands after them.

    (offer_id, rule, number, detected_seq, status, reason, price_cents, reference_cents, detected_at,
    confirmed_at, closed_at, refreshes): an offer's deals under a rule are numbered from 1. Price and
    reference are those of the last event that sets them, so a rejection or an expiry leaves them.
    Offers without a number are one offer.
    """
    mine = Window.partitionBy("offer_id", "rule").orderBy("observed_at", F.col("event") != "rejected", F.col("event") != "expired")
    at, event = F.col("observed_at"), F.col("event")
    numbered = events.withColumn("number", F.sum(F.when(event == "detected", 1).otherwise(0)).over(mine))
    sets = event.isin("detected", "confirmed", "refreshed")
    decides = event.isin("confirmed", "rejected", "expired")
    last = lambda column, test: F.max_by(F.when(test, F.col(column)), F.when(test, at))
    return numbered.groupBy("offer_id", "rule", "number").agg(
        F.min(F.when(event == "detected", F.col("seq"))).alias("detected_seq"), F.max_by("status", at).alias("status"), last("reason", decides).alias("reason"),
        last("price_cents", sets).alias("price_cents"), last("reference_cents", sets).alias("reference_cents"), F.min(at).alias("detected_at"),
        F.min(F.when(event == "confirmed", at)).alias("confirmed_at"), F.max(F.when(F.col("status").isin("REJECTED", "EXPIRED"), at)).alias("closed_at"), F.count_if(event == "refreshed").alias("refreshes"),
    )
