"""Detection rules, confirmation checks and rechecks, all as Columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import RULES, USED_RULE_CONDITIONS, Rules
from ..functions.basics import first_reason
from ..functions.money import comparable_cents, discount_bp


def _deep(price: Column, reference: Column, rules: Rules) -> Column:
    return ((reference - price) >= rules.min_saving_cents) & (discount_bp(price, reference) >= rules.min_discount_bp)


def detect_new(price: Column, reference: Column, condition: Column, availability: Column, rules: Rules = RULES) -> Column:
    return F.coalesce((condition == "NEW") & availability.isin("IN_STOCK", "STORE_ONLY") & _deep(price, reference, rules), F.lit(False))


def detect_claimed(price: Column, claimed: Column, verified: Column, condition: Column, on_clearance: Column, rules: Rules = RULES) -> Column:
    """On the shop's own claim, where nothing verified is known. Availability plays no part."""
    return F.coalesce((condition == "NEW") & verified.isNull() & on_clearance & _deep(price, claimed, rules), F.lit(False))


def detect_used(price: Column, shipping: Column, reference: Column, condition: Column, availability: Column, rules: Rules = RULES) -> Column:
    landed = comparable_cents(price, shipping)
    return F.coalesce(condition.isin(*USED_RULE_CONDITIONS) & (availability == "IN_STOCK") & _deep(landed, reference, rules), F.lit(False))


def failed_check(c, bp: Column, rules: Rules = RULES) -> Column:
    """The first confirmation check that fails, or null.

    ``c`` maps names to Columns: minutes_since_detection, detected_via, page_type, same_offer,
    detected_key, confirming_key, listing_key, detected_units, confirming_units, listing_units,
    quality, other_reason (first reason but large_move), price_cents, detected_cents,
    reference_cents, reference_key, reference_units, reference_group, condition_group, floor_cents.
    ``bp`` is the discount in basis points.
    """
    no = lambda test: F.coalesce(test, F.lit(False))
    price = c("price_cents")
    same = c("detected_key").eqNullSafe(c("confirming_key")) & c("confirming_key").eqNullSafe(c("listing_key"))
    same &= c("detected_units").eqNullSafe(c("confirming_units")) & c("confirming_units").eqNullSafe(c("listing_units"))
    return first_reason(
        [
            ("confirm_too_soon", c("minutes_since_detection") < rules.min_confirm_minutes),
            ("confirm_not_from_product_page", (c("detected_via") == "GRID") & (c("page_type") != "PRODUCT")),
            ("offer_identity_mismatch", ~c("same_offer")),
            ("variant_mismatch", ~same),
            ("quality:rejected", c("quality") == "REJECTED"),
            ("quality:suspect", (c("quality") == "SUSPECT") & c("other_reason").isNotNull()),
            ("price_changed", price > c("detected_cents") * rules.price_tolerance),
            ("below_threshold_on_confirm", F.coalesce(bp, F.lit(0)) < rules.min_discount_bp),
            ("reference_scope_mismatch", no(c("reference_key") != c("confirming_key")) | no(c("reference_units") != c("confirming_units")) | no(c("reference_group") != c("condition_group"))),
            ("below_floor", price < c("floor_cents")),
            ("implausible_discount", bp > rules.implausible_bp),
        ]
    )


def _verdict(reason: Column, bp: Column, other: Column, rules: Rules) -> dict[str, Column]:
    held = reason.isNull() & (bp > rules.held_upper_bp)
    return {
        "status": F.when(reason.isNotNull(), "REJECTED").when(held, "HELD_REVIEW").otherwise("ACTIVE"),
        "reject_reason": F.when(reason == "quality:suspect", F.concat(F.lit("quality:"), other)).otherwise(reason),
        "hold_reason": F.when(held, "discount_85_to_95"),
    }


def confirm(c, rules: Rules = RULES) -> Column:
    """Struct (status, reject_reason, hold_reason) of the fields of ``failed_check``."""
    bp = discount_bp(c("price_cents"), c("reference_cents"))
    return F.struct(*[column.alias(name) for name, column in _verdict(failed_check(c, bp, rules), bp, c("other_reason"), rules).items()])


def confirmed(df: DataFrame, c, rules: Rules = RULES) -> DataFrame:
    """``df`` with status, reject_reason and hold_reason. Discount and failed check are columns of
    their own (bp, failed_check), each computed once, so the generated code stays small enough to be
    compiled."""
    found = df.withColumn("bp", discount_bp(c("price_cents"), c("reference_cents")))
    found = found.withColumn("failed_check", failed_check(c, F.col("bp"), rules))
    return found.withColumns(_verdict(F.col("failed_check"), F.col("bp"), c("other_reason"), rules))


def discount_band(bp: Column, rules: Rules = RULES) -> Column:
    return F.when(bp > rules.implausible_bp, "REJECTED").when(bp > rules.held_upper_bp, "HELD_REVIEW").when(bp >= rules.min_discount_bp, "ACTIVE").otherwise("NONE")


def recheck(price: Column, stored: Column, reference: Column, availability: Column, rules: Rules = RULES) -> Column:
    """Why an active deal expires at an observation, or null if it is refreshed."""
    return first_reason(
        [
            ("sold_out", ~availability.isin("IN_STOCK", "STORE_ONLY")),
            ("reference_lost", reference.isNull()),
            ("price_recovered", (price > stored * rules.price_tolerance) | (discount_bp(price, reference) < rules.min_discount_bp)),
        ]
    )


def queue_priority(known: Column, implied_bp: Column) -> Column:
    """Fast track from 45 percent on, also for known URLs; new ones after; null: nothing to queue."""
    return F.when(implied_bp >= 4500, 15).when(~known, 40)
