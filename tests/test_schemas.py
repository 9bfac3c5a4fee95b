"""Schema checks of JSON documents."""

import copy
import json

import pytest

from tidemark.operators import schemas as S

DEAL = {
    "deal_id": "d", "lane": "VERIFIED", "rule": "DEEP_DISCOUNT_NEW", "product_slug": "p", "product_name": "P", "brand": "B", "category": "rod", "variant_pub_id": "v", "variant_label": "V", "retailer_slug": "s",
    "retailer_url": "https://s.example.com/", "condition": "NEW", "seller_name": "S", "seller_type": "FIRST_PARTY", "price_cents": 100, "shipping_cents": None, "landed_price_cents": None,
    "reference": {"kind": "OWN_HISTORY_MEDIAN_90D", "cents": 300, "label": "L"}, "claimed_reference": None, "discount_pct": 66.67, "availability": "IN_STOCK", "stock_qty": None, "first_confirmed_at": "t", "last_confirmed_at": "t",
}
OFFER = {"retailer_slug": "s", "url": "u", "condition": "NEW", "seller_name": "S", "seller_type": "MARKETPLACE", "price_cents": 0, "shipping_cents": 5, "availability": "STORE_ONLY", "on_clearance": False, "observed_at": "t"}
PRODUCT = {"slug": "p", "name": "P", "brand": "B", "category": "line", "variants": [{"variant_pub_id": "v", "label": "L", "attributes": {}, "offers": [OFFER, dict(OFFER)], "history": [{"date": "d", "retailer_slug": "s", "condition_group": "REFURB", "price_cents": 1}]}]}
META = {"schema_version": 2, "export_id": "e", "generated_at": "t", "retailers": [], "counts": dict.fromkeys(("products", "offers_tracked", "verified_deals", "claimed_deals", "used_deals"), 0), "thresholds": {"min_discount_pct": 50.0}}
GONE = object()


def changed(document, path, value):
    made = copy.deepcopy(document)
    *steps, last = path
    at = made
    for s in steps:
        at = at[s]
    if value is GONE:
        del at[last]
    else:
        at[last] = value
    return made


CASES = [
    (S.DEAL, DEAL, [((k,), GONE, (k, "required")) for k in DEAL]
     + [((k,), "", (k, "empty")) for k in ("deal_id", "brand", "first_confirmed_at")] + [((k,), 5, (k, "type")) for k in ("deal_id", "retailer_url")] + [((k,), "ODD", (k, "enum")) for k in ("lane", "rule", "category", "condition", "seller_type", "availability")]
     + [(("price_cents",), 0, ("price_cents", "bounds")), (("price_cents",), "1", ("price_cents", "type")), (("price_cents",), 1.5, ("price_cents", "type")), (("price_cents",), True, ("price_cents", "type")), (("price_cents",), 2.0, None),
        (("price_cents",), None, ("price_cents", "type")), (("shipping_cents",), 0, None), (("shipping_cents",), "0", ("shipping_cents", "type")), (("discount_pct",), 100, None), (("discount_pct",), 100.01, ("discount_pct", "bounds")), (("discount_pct",), -1, ("discount_pct", "bounds")),
        (("reference",), None, None), (("reference",), "x", ("reference", "type")), (("reference", "cents"), 0, ("reference.cents", "bounds")), (("reference", "label"), "", ("reference.label", "empty")), (("reference", "kind"), "RETAILER_CLAIMED", ("reference.kind", "enum")),
        (("reference", "observed_days"), 3, None), (("reference", "observed_days"), "3", ("reference.observed_days", "type")), (("reference", "more"), 1, ("reference", "extra_keys")), (("more",), 1, None), (("retailer_name",), "", None), (("retailer_name",), 4, ("retailer_name", "type")),
        (("claimed_reference",), {"kind": "WAS", "cents": 5, "inflated_vs_reference": None}, ("claimed_reference.inflated_vs_reference", "type"))]),
    (S.PRODUCT, PRODUCT, [(("variants",), {}, ("variants", "type")), (("variants",), [], None), (("variants", 0, "offers", 1, "price_cents"), -1, ("variants.0.offers.1.price_cents", "bounds")), (("variants", 0, "offers", 0, "on_clearance"), GONE, ("variants.0.offers.0.on_clearance", "required")),
        (("variants", 0, "history", 0, "price_cents"), 0, ("variants.0.history.0.price_cents", "bounds")), (("variants", 0, "attributes"), [], ("variants.0.attributes", "type")), (("variants", 0), 7, ("variants.0", "type"))]),
    (S.META, META, [(("schema_version",), 1, ("schema_version", "enum")), (("schema_version",), "2", ("schema_version", "enum")), (("counts", "products"), -1, ("counts.products", "bounds")), (("thresholds",), {}, ("thresholds.min_discount_pct", "required")), (("is_sample_data",), "no", ("is_sample_data", "type")), (("retailers",), [{}], "six")]),
]


@pytest.mark.parametrize(("schema", "document", "cases"), CASES, ids=["deal", "product", "meta"])
def test_one_row_for_each_broken_path(spark, schema, document, cases):
    rows = [(-1, json.dumps(document))] + [(k, json.dumps(changed(document, path, value))) for k, (path, value, _) in enumerate(cases)]
    got = {}
    for r in S.schema_violations(spark.createDataFrame(rows, "k long, j string"), "j", schema, "k").collect():
        got.setdefault(r.k, []).append((r.path, r.rule))
    for k, (_, _, expected) in enumerate(cases):
        if expected == "six":
            assert len(got[k]) == 6 and {rule for _, rule in got[k]} == {"required"}
        else:
            assert got.get(k, []) == ([expected] if expected else []), cases[k]
    assert -1 not in got


def test_texts_that_are_no_documents(spark):
    rows = [(1, None), (2, ""), (3, "{"), (4, "null"), (5, "[]"), (6, json.dumps({"generated_at": "t", "deals": [DEAL, 5, DEAL | {"lane": 1}]}))]
    got = sorted((r.k, r.path, r.rule) for r in S.schema_violations(spark.createDataFrame(rows, "k long, j string"), "j", S.FEED, "k").collect())
    assert got == [(1, "", "json"), (2, "", "json"), (3, "", "json"), (4, "", "type"), (5, "", "type"), (6, "deals.1", "type"), (6, "deals.2.lane", "enum")]


def test_each_value_is_made_once(spark):
    """Values that a schema looks at are columns: none is taken from its document again for every rule."""
    before = spark.conf.get("spark.sql.debug.maxToStringFields")
    spark.conf.set("spark.sql.debug.maxToStringFields", "10000")
    try:
        plan = S.schema_violations(spark.createDataFrame([(1, json.dumps(DEAL))], "k long, body string"), "body", S.DEAL, "k")._jdf.queryExecution().optimizedPlan().toString().lower()
    finally:
        spark.conf.set("spark.sql.debug.maxToStringFields", before)
    # One kind for the document and one for each of its keys, those of its two nested objects too.
    assert plan.count("schemaofvariant.schemaofvariant(") == 1 + len(S.DEAL) + len(S.REFERENCE.of) + len(S.CLAIMED.of)
