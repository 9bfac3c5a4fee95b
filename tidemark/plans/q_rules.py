"""Detection, confirmation and guards."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.money import discount_bp
from ..operators import guards, rules
from ..operators.references import last_ok_before
from ..operators.sweeps import with_sweep_counts
from ..sources.files import table
from .registering import query
from .star import GAP_SECONDS, OBSERVATIONS, PAGES, SWEEPS, event_observations, observations, on_pages

#: Rows with everything the rules look at, the same in both engines.
CASES = f"""
WITH {OBSERVATIONS}, cases AS (
  SELECT o.offer_id, o.seq, o.price_cents, o.shipping_cents, o.availability, o.on_clearance, o.quality,
         CASE o.offer_id % 10 WHEN 7 THEN 'USED_GOOD' WHEN 8 THEN 'NEW_OPEN_BOX' WHEN 9 THEN 'USED_ACCEPTABLE' ELSE 'NEW' END AS condition,
         CAST(round(p.p_retailprice * 100) AS BIGINT) * 20 AS reference_cents,
         CASE WHEN o.offer_id % 2 = 0 THEN CAST(round(p.p_retailprice * 100) AS BIGINT) * 20 END AS verified_cents,
         CAST(round(p.p_retailprice * 100) AS BIGINT) * 22 AS claimed_cents
  FROM obs o JOIN part p ON p.p_partkey = o.offer_id
)"""
BP = "CAST(round(({r} - {p}) * 10000.0::DOUBLE / {r}) AS BIGINT)"


def cases(spark, sf_dir):
    retail = F.round(F.col("p_retailprice") * 100).cast("bigint")
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("offer_id"), retail.alias("retail"))
    last = F.col("offer_id") % 10
    return observations(spark, sf_dir).join(part, "offer_id").select(
        "offer_id", "seq", "price_cents", "shipping_cents", "availability", "on_clearance", "quality",
        F.when(last == 7, "USED_GOOD").when(last == 8, "NEW_OPEN_BOX").when(last == 9, "USED_ACCEPTABLE").otherwise("NEW").alias("condition"),
        (F.col("retail") * 20).alias("reference_cents"),
        F.when(F.col("offer_id") % 2 == 0, F.col("retail") * 20).alias("verified_cents"),
        (F.col("retail") * 22).alias("claimed_cents"),
    )


@query(
    f"""{CASES} SELECT offer_id, seq, {BP.format(p="price_cents", r="reference_cents")} AS discount_bp FROM cases
    WHERE condition = 'NEW' AND availability IN ('IN_STOCK', 'STORE_ONLY') AND reference_cents - price_cents >= 1000 AND {BP.format(p="price_cents", r="reference_cents")} >= 5000"""
)
def detect_new(spark, sf_dir):
    c = cases(spark, sf_dir)
    hit = rules.detect_new(F.col("price_cents"), F.col("reference_cents"), F.col("condition"), F.col("availability"))
    return c.where(hit).select("offer_id", "seq", discount_bp(F.col("price_cents"), F.col("reference_cents")).alias("discount_bp"))


@query(
    f"""{CASES} SELECT offer_id, seq, {BP.format(p="price_cents", r="claimed_cents")} AS discount_bp FROM cases
    WHERE condition = 'NEW' AND verified_cents IS NULL AND on_clearance AND claimed_cents - price_cents >= 1000 AND {BP.format(p="price_cents", r="claimed_cents")} >= 5000"""
)
def detect_claimed(spark, sf_dir):
    c = cases(spark, sf_dir)
    hit = rules.detect_claimed(F.col("price_cents"), F.col("claimed_cents"), F.col("verified_cents"), F.col("condition"), F.col("on_clearance"))
    return c.where(hit).select("offer_id", "seq", discount_bp(F.col("price_cents"), F.col("claimed_cents")).alias("discount_bp"))


LANDED = "coalesce(price_cents + shipping_cents, price_cents)"


@query(
    f"""{CASES} SELECT offer_id, seq, {BP.format(p=LANDED, r="reference_cents")} AS discount_bp FROM cases
    WHERE condition IN ('NEW_OPEN_BOX', 'USED_GOOD') AND availability = 'IN_STOCK' AND reference_cents - {LANDED} >= 1000 AND {BP.format(p=LANDED, r="reference_cents")} >= 5000"""
)
def detect_used(spark, sf_dir):
    c = cases(spark, sf_dir)
    hit = rules.detect_used(F.col("price_cents"), F.col("shipping_cents"), F.col("reference_cents"), F.col("condition"), F.col("availability"))
    landed = F.coalesce(F.col("price_cents") + F.col("shipping_cents"), F.col("price_cents"))
    return c.where(hit).select("offer_id", "seq", discount_bp(landed, F.col("reference_cents")).alias("discount_bp"))


@query(
    f"""{CASES}, banded AS (SELECT offer_id, seq, {BP.format(p="price_cents", r="reference_cents")} AS discount_bp FROM cases)
    SELECT *, CASE WHEN discount_bp > 9500 THEN 'REJECTED' WHEN discount_bp > 8500 THEN 'HELD_REVIEW' WHEN discount_bp >= 5000 THEN 'ACTIVE' ELSE 'NONE' END AS band FROM banded"""
)
def discount_band(spark, sf_dir):
    c = cases(spark, sf_dir).select("offer_id", "seq", discount_bp(F.col("price_cents"), F.col("reference_cents")).alias("discount_bp"))
    return c.withColumn("band", rules.discount_band(F.col("discount_bp")))


@query(
    f"""{CASES}, given AS (
      SELECT *, offer_id % 30 AS minutes, CASE WHEN offer_id % 11 = 0 THEN 'GRID' ELSE 'PAGE' END AS via, CASE WHEN offer_id % 13 = 0 THEN 'LISTING' ELSE 'PRODUCT' END AS page,
        offer_id % 17 <> 0 AS same_offer, nullif(offer_id % 5, 0) AS units, nullif((offer_id + offer_id % 19 // 18) % 5, 0) AS units2,
        CASE WHEN offer_id % 7 = 0 THEN 'out_of_band' END AS other, 'k' || offer_id % 3 AS key1, CASE WHEN offer_id % 23 = 0 THEN 'other' ELSE 'k' || offer_id % 3 END AS key2, CASE offer_id % 37 WHEN 0 THEN 'z' WHEN 1 THEN NULL ELSE 'k' || offer_id % 3 END AS ref_key,
        CASE WHEN offer_id % 43 = 0 THEN 99 END AS ref_units, CAST(round(price_cents * (1 + (offer_id % 3 - 1) * 0.05)) AS BIGINT) AS was, {BP.format(p="price_cents", r="reference_cents")} AS bp FROM cases
    ), told AS (
      SELECT *, CASE WHEN minutes < 10 THEN 'confirm_too_soon' WHEN via = 'GRID' AND page <> 'PRODUCT' THEN 'confirm_not_from_product_page'
        WHEN NOT same_offer THEN 'offer_identity_mismatch' WHEN key1 IS DISTINCT FROM key2 OR units IS DISTINCT FROM units2 THEN 'variant_mismatch'
        WHEN quality = 'SUSPECT' AND other IS NOT NULL THEN 'quality:' || other WHEN price_cents > was * 1.02::DOUBLE THEN 'price_changed'
        WHEN bp < 5000 THEN 'below_threshold_on_confirm' WHEN coalesce(ref_key <> key2, FALSE) OR coalesce(ref_units <> units2, FALSE) OR condition LIKE 'USED%' THEN 'reference_scope_mismatch' WHEN price_cents < 150000 THEN 'below_floor'
        WHEN bp > 9500 THEN 'implausible_discount' END AS reject_reason FROM given
    ) SELECT offer_id, seq, CASE WHEN reject_reason IS NOT NULL THEN 'REJECTED' WHEN bp > 8500 THEN 'HELD_REVIEW' ELSE 'ACTIVE' END AS status, reject_reason,
    CASE WHEN reject_reason IS NULL AND bp > 8500 THEN 'discount_85_to_95' END AS hold_reason FROM told"""
)
def confirm_checks(spark, sf_dir):
    o = F.col("offer_id")
    units = F.nullif(o % 5, F.lit(0))
    key = F.concat(F.lit("k"), (o % 3).cast("string"))
    other_key = F.when(o % 23 == 0, "other").otherwise(key)
    fields = {
        "minutes_since_detection": o % 30,
        "detected_via": F.when(o % 11 == 0, "GRID").otherwise("PAGE"),
        "page_type": F.when(o % 13 == 0, "LISTING").otherwise("PRODUCT"),
        "same_offer": o % 17 != 0,
        "detected_key": key,
        "confirming_key": other_key,
        "listing_key": other_key,
        "detected_units": units,
        "confirming_units": F.nullif((o + F.expr("(offer_id % 19) div 18")) % 5, F.lit(0)),
        "listing_units": F.nullif((o + F.expr("(offer_id % 19) div 18")) % 5, F.lit(0)),
        "quality": F.col("quality"),
        "other_reason": F.when(o % 7 == 0, "out_of_band"),
        "price_cents": F.col("price_cents"),
        "detected_cents": F.round(F.col("price_cents") * (1 + (o % 3 - 1) * 0.05)).cast("bigint"),
        "reference_cents": F.col("reference_cents"),
        "reference_key": F.when(o % 37 == 0, "z").when(o % 37 != 1, key),
        "reference_units": F.when(o % 43 == 0, 99),
        "reference_group": F.lit("NEW"),
        "condition_group": F.when(F.col("condition").startswith("USED"), "USED").otherwise("NEW"),
        "floor_cents": F.lit(150000),
    }
    done = rules.confirmed(cases(spark, sf_dir).select("offer_id", "seq", *[column.alias(f"f_{name}") for name, column in fields.items()]), lambda name: F.col(f"f_{name}"))
    return done.select("offer_id", "seq", "status", "reject_reason", "hold_reason")


@query(
    f"""{CASES} SELECT offer_id, seq, CASE WHEN {BP.format(p="price_cents", r="claimed_cents")} >= 4500 THEN 15 WHEN NOT (offer_id % 2 = 0) THEN 40 END AS priority FROM cases"""
)
def implied_discount_priority(spark, sf_dir):
    c = cases(spark, sf_dir)
    return c.select("offer_id", "seq", rules.queue_priority(F.col("offer_id") % 2 == 0, discount_bp(F.col("price_cents"), F.col("claimed_cents"))).alias("priority"))


@query(
    f"""WITH {OBSERVATIONS}, {SWEEPS}, ctx AS (
      SELECT o.*, variants, prices, previous_variants AS pv, previous_prices AS pp,
        last_value(CASE WHEN quality = 'OK' THEN price_cents END IGNORE NULLS) OVER (PARTITION BY offer_id ORDER BY observed_at, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last
      FROM (SELECT *, offer_id % {PAGES} AS page_key FROM obs) AS o JOIN sw USING (page_key, observed_at) JOIN counts USING (page_key, sweep)
    ), flags AS (
      SELECT offer_id, seq, price_cents <= 0 AS bad, price_cents < 20000 OR price_cents > 5000000 AS band,
        coalesce(price_cents::DOUBLE / last * 100 < 35.0 OR price_cents::DOUBLE / last * 100 > 300.0, FALSE) AS move,
        on_clearance AND 3000000 <= price_cents AS claim,
        coalesce(last > 0 AND CASE WHEN unit_count > 0
          THEN abs(price_cents::DOUBLE / last - 1.0::DOUBLE / unit_count) <= 0.05::DOUBLE OR abs(price_cents::DOUBLE / last - unit_count) <= 0.05::DOUBLE
          ELSE list_bool_or(list_transform([3, 4, 5, 6, 10, 12, 20, 25, 50], lambda n: abs(price_cents::DOUBLE / last - 1.0::DOUBLE / n) <= 0.05::DOUBLE OR abs(price_cents::DOUBLE / last - n) <= 0.05::DOUBLE)) END, FALSE) AS unit,
        offer_id % 29 = 0 AS odd, offer_id % 31 = 0 AS changed, 
        coalesce(pv > 0 AND (variants < 0.5::DOUBLE * pv OR (pv - variants) * 100 >= 70 * pv), FALSE) AS collapsed, coalesce(pp >= 3 AND prices = 1, FALSE) AS flat FROM ctx
    ) SELECT offer_id, seq, CASE WHEN bad THEN 'invalid_price_or_currency' ELSE concat_ws(',', CASE WHEN band THEN 'out_of_band' END, CASE WHEN move THEN 'large_move' END,
      CASE WHEN claim THEN 'claimed_not_above_price' END, CASE WHEN unit THEN 'unit_mismatch' END,
      CASE WHEN changed THEN 'variant_identity_changed' END, CASE WHEN collapsed THEN 'variant_collapse' END, CASE WHEN flat THEN 'price_flattening' END, CASE WHEN odd THEN 'condition_unknown' END) END AS reasons,
      CASE WHEN bad THEN 'REJECTED' WHEN band OR move OR claim OR unit OR changed OR collapsed OR flat OR odd THEN 'SUSPECT' ELSE 'OK' END AS verdict FROM flags"""
)
def guard_flags(spark, sf_dir):
    odd = F.col("offer_id") % 29 == 0
    rows = (
        last_ok_before(with_sweep_counts(on_pages(observations(spark, sf_dir)), GAP_SECONDS))
        .withColumns({
            "band_floor": F.lit(20000), "band_ceiling": F.lit(5000000), "claimed_cents": F.lit(3000000), "listing_unit_count": F.lit(None).cast("bigint"),
            "wording": F.when(odd, "mystery").otherwise("new"), "condition": F.when(~odd, "NEW"), "used_page": F.lit(False),
            "variant_key": F.when(F.col("offer_id") % 31 == 0, "red").otherwise("blue"), "listing_variant_key": F.when(F.col("offer_id") % 5 != 1, "blue").when(F.col("offer_id") % 31 == 0, "blue"),
        })
        .drop("quality")
    )
    judged = guards.judged(rows)
    return judged.select("offer_id", "seq", F.array_join("quality_reasons", ",").alias("reasons"), F.col("quality").alias("verdict"))


@query(
    """WITH RECURSIVE o AS (
      SELECT user_id AS offer_id, lpad(CAST(event_id AS VARCHAR), 12, '0') AS seq, CASE WHEN event_id % 53 <> 0 THEN CAST(round(value * 100) AS BIGINT) END AS price, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events
    ), f AS (
      SELECT offer_id, seq, k, price, CAST(NULL AS BIGINT) AS last, coalesce(price > 0, FALSE) AS ok FROM o WHERE k = 1
      UNION ALL
      SELECT o.offer_id, o.seq, o.k, o.price, CASE WHEN f.ok THEN f.price ELSE f.last END,
        coalesce(o.price > 0 AND NOT coalesce((CASE WHEN f.ok THEN f.price ELSE f.last END) > 0 AND (o.price::DOUBLE / (CASE WHEN f.ok THEN f.price ELSE f.last END) * 100 < 35.0
          OR o.price::DOUBLE / (CASE WHEN f.ok THEN f.price ELSE f.last END) * 100 > 300.0), FALSE), FALSE)
      FROM f JOIN o ON o.offer_id = f.offer_id AND o.k = f.k + 1
    ) SELECT offer_id, seq, last AS last_ok_cents, CASE WHEN ok THEN 'OK' ELSE 'SUSPECT' END AS quality FROM f"""
)
def guard_recurrence(spark, sf_dir):
    return guards.guard_recurrence(event_observations(spark, sf_dir))


@query(
    """SELECT 'price_positive' AS rule, count(*) FILTER (WHERE NOT l_extendedprice > 0) AS violations FROM lineitem
    UNION ALL SELECT 'discount_range', count(*) FILTER (WHERE NOT l_discount BETWEEN 0 AND 0.05) FROM lineitem
    UNION ALL SELECT 'status_known', count(*) FILTER (WHERE NOT l_linestatus IN ('O')) FROM lineitem"""
)
def constraint_report(spark, sf_dir):
    checks = {"price_positive": F.col("l_extendedprice") > 0, "discount_range": F.col("l_discount").between(0, 0.05), "status_known": F.col("l_linestatus").isin("O")}
    return guards.constraint_report(table(spark, sf_dir, "lineitem"), checks)
