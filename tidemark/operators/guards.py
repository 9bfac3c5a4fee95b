"""Quality guards on observations and table constraints."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import RULES, Rules
from ..functions.basics import reasons


def _or_false(test: Column) -> Column:
    return F.coalesce(test, F.lit(False))


def move_guard(price: Column, last: Column, rules: Rules = RULES) -> Column:
    ratio = F.try_divide(price, last) * 100
    return _or_false((last > 0) & ((ratio < rules.move_low_pct) | (ratio > rules.move_high_pct)))


def pack_guard(price: Column, last: Column, count: Column, listing_count: Column, rules: Rules = RULES) -> Column:
    """Both counts known and different; or the listing's unknown and the price moved by what looks like a pack."""
    ratio = F.try_divide(price, last)
    near = lambda n: (F.abs(ratio - F.try_divide(F.lit(1), n)) <= rules.unit_tolerance) | (F.abs(ratio - n) <= rules.unit_tolerance)
    guessed = F.exists(F.array(*[F.lit(float(n)) for n in rules.unit_guesses]), near)
    told = _or_false((count.isNotNull() & listing_count.isNotNull()) & (count != listing_count))
    odd = F.when(count.isNotNull() & (count > 0), near(count.cast("double"))).otherwise(guessed)
    return told | _or_false(listing_count.isNull() & (last > 0) & odd)


def guard_pairs(c, rules: Rules = RULES) -> list[tuple[str, Column]]:
    """All guards in reporting order; ``c`` maps a field's name to its Column.

    Fields: price_cents, currency, band_floor, band_ceiling, last_price, on_clearance,
    claimed_cents, unit_count, listing_unit_count, variant_key, listing_variant_key, variants,
    previous_variants, prices, previous_prices, condition, wording, used_page.
    """
    price, last = c("price_cents"), c("last_price")
    return [
        ("out_of_band", _or_false((price < c("band_floor")) | (price > c("band_ceiling")))),
        ("large_move", move_guard(price, last, rules)),
        ("claimed_not_above_price", _or_false(c("on_clearance") & (c("claimed_cents") <= price))),
        ("unit_mismatch", pack_guard(price, last, c("unit_count"), c("listing_unit_count"), rules)),
        ("variant_identity_changed", _or_false(c("variant_key") != c("listing_variant_key"))),
        ("variant_collapse", _or_false((c("previous_variants") > 0) & ((c("variants") < 0.5 * c("previous_variants")) | ((c("previous_variants") - c("variants")) * 100 >= 70 * c("previous_variants"))))),
        ("price_flattening", _or_false((c("previous_prices") >= 3) & (c("prices") == 1))),
        ("condition_unknown", _or_false(c("wording").isNotNull() & c("condition").isNull() & ~c("used_page"))),
    ]


def _verdict(df: DataFrame, rules: Rules, without: frozenset | set = frozenset()) -> tuple[Column, Column]:
    """(reasons, quality) from the guards over the fields that ``df`` has."""
    have = set(df.columns)
    kinds = {"currency": "string", "variant_key": "string", "listing_variant_key": "string", "condition": "string", "wording": "string", "on_clearance": "boolean", "used_page": "boolean"}
    field = lambda n: F.col(n) if n in have else F.lit(None).cast(kinds.get(n, "bigint"))
    invalid = F.coalesce(F.col("price_cents") <= 0, F.lit(True)) | (F.coalesce(field("currency"), F.lit("USD")) != "USD")
    found = reasons([(n, c) for n, c in guard_pairs(field, rules) if n not in without])
    told = F.when(invalid, F.array(F.lit("invalid_price_or_currency"))).otherwise(found)
    return told, F.when(invalid, "REJECTED").when(F.size(found) == 0, "OK").otherwise("SUSPECT")


def judged(df: DataFrame, rules: Rules = RULES) -> DataFrame:
    """Adds quality and quality_reasons from the guards over the fields that ``df`` has."""
    told, quality = _verdict(df, rules)
    return df.withColumn("quality_reasons", told).withColumn("quality", quality)


def moved(price: int, last: int | None, rules: Rules = RULES) -> bool:
    """``move_guard`` for plain numbers."""
    return bool(last) and last > 0 and not rules.move_low_pct <= price / last * 100 <= rules.move_high_pct


def packed(price: int, last: int | None, count: int | None, listing_count: int | None, rules: Rules = RULES) -> bool:
    """``pack_guard`` for plain numbers."""
    if count is not None and listing_count is not None:
        return count != listing_count
    if listing_count is not None or not last or last <= 0:
        return False
    guesses = (count,) if count is not None and count > 0 else rules.unit_guesses
    return any(abs(price / last - x) <= rules.unit_tolerance for n in guesses for x in (1 / n, float(n)))


def next_ok(price: int | None, last: int | None, sound: bool, count: int | None, listing_count: int | None, rules: Rules = RULES, packs: bool = True) -> int | None:
    """The last OK price after a row: its own if no guard speaks against it. ``sound``: what the other guards say."""
    fine = sound and price is not None and price > 0 and not moved(price, last, rules) and not (packs and packed(price, last, count, listing_count, rules))
    return price if fine else last


def sound(df: DataFrame, rules: Rules = RULES) -> Column:
    """Whether a row's price is valid and no guard speaks against it but those that need the last OK price."""
    return F.col("quality") == "OK" if "quality" in df.columns else _verdict(df, rules, {"large_move", "unit_mismatch"})[1] == "OK"


def with_last_ok(df: DataFrame, rules: Rules = RULES, packs: bool = True) -> DataFrame:
    """Adds last_price: the price of the offer's last earlier row that is OK itself.

    Whether a row is OK depends on the OK row before it, which no window expresses. An offer's rows
    stream through one task in order of time; one price is all that is held.
    """
    have = set(df.columns)
    facts = [F.col(c).cast("long") if c in have else F.lit(None).cast("long") for c in ("price_cents", "unit_count", "listing_unit_count")]
    ordered = df.withColumns({"fact_": F.struct(facts[0].alias("price"), facts[1].alias("count"), facts[2].alias("listed"), F.coalesce(sound(df, rules), F.lit(False)).alias("sound"))}).repartition("offer_id").sortWithinPartitions("offer_id", "observed_at", "seq")
    place, key = len(df.columns), df.columns.index("offer_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        offer, last, begun = None, None, False
        for batch in batches:
            found = []
            for at, fact in zip(batch.column(key).to_pylist(), batch.column(place).to_pylist()):
                if not begun or at != offer:
                    offer, last, begun = at, None, True
                found.append(last)
                last = next_ok(fact["price"], last, fact["sound"], fact["count"], fact["listed"], rules, packs)
            yield pa.RecordBatch.from_arrays([*batch.columns[:place], pa.array(found, pa.int64())], [*batch.schema.names[:place], "last_price"])

    return ordered.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("last_price", T.LongType())]))


def guard_recurrence(observations: DataFrame, rules: Rules = RULES) -> DataFrame:
    """Quality under large_move against the last row that is itself OK, offer by offer in time order."""
    rows = observations.select("offer_id", "observed_at", "seq", "price_cents", F.when(F.col("price_cents") > 0, "OK").alias("quality"))
    done = with_last_ok(rows, rules, packs=False)
    ok = F.coalesce((F.col("quality") == "OK") & ~move_guard(F.col("price_cents"), F.col("last_price"), rules), F.lit(False))
    return done.select("offer_id", "seq", F.col("last_price").alias("last_ok_cents"), F.when(ok, "OK").otherwise("SUSPECT").alias("quality"))


def constraint_report(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, violations): rows for which a rule does not hold; a null verdict is no violation."""
    counts = df.agg(*[F.count_if(~rule).alias(name) for name, rule in rules.items()])
    return counts.select(F.explode(F.create_map(*[x for n in rules for x in (F.lit(n), F.col(n))])).alias("rule", "violations"))
