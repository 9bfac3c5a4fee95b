"""Checks of JSON documents against a schema, compiled into one expression over VARIANT values.

A schema is written with plain values: a dict is an object whose keys are required unless they end
with ``?``, a list of one schema is an array, a tuple is the values allowed, a text names a kind:
``text`` (not empty), ``string``, ``int``, ``number``, ``bool``, ``object``, with a bound such as
``int>0`` or ``number 0..100`` where one applies. ``Nullable`` lets null pass, ``Closed`` lets no further
keys into an object.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import CATEGORY_BANDS, CONDITION_GROUPS


@dataclass(frozen=True)
class Nullable:
    of: object


@dataclass(frozen=True)
class Closed:
    of: dict


# The feed's contract.
LANES = ("VERIFIED", "CLAIMED", "USED")
DEAL_RULES = ("DEEP_DISCOUNT_NEW", "DEEP_DISCOUNT_CLAIMED", "USED_VS_CURRENT_NEW")
CONDITIONS = tuple(CONDITION_GROUPS)
SHOWN_GROUPS = ("NEW", "OPEN_BOX", "REFURB", "USED")
CATEGORIES = tuple(CATEGORY_BANDS)
STOCK = ("IN_STOCK", "STORE_ONLY", "OUT_OF_STOCK")
SELLERS = ("FIRST_PARTY", "MARKETPLACE")
HEALTH = ("HEALTHY", "DEGRADED", "FAILED")
REFERENCE = Closed({"kind": ("OWN_HISTORY_MEDIAN_90D", "CROSS_RETAILER_NEW", "DATA_API_HISTORY"), "cents": "int>0", "label": "text", "observed_days?": "int"})
CLAIMED = Closed({"kind": ("MSRP", "WAS", "LIST"), "cents": "int>0", "inflated_vs_reference": "bool"})
DEAL = {
    "deal_id": "text", "lane": LANES, "rule": DEAL_RULES, "product_slug": "text", "product_name": "text", "brand": "text", "category": CATEGORIES, "variant_pub_id": "text", "variant_label": "text", "retailer_slug": "text",
    "retailer_name?": "string", "retailer_url": "text", "condition": CONDITIONS, "seller_name": "text", "seller_type": SELLERS, "price_cents": "int>0", "shipping_cents": Nullable("int"), "landed_price_cents": Nullable("int"),
    "reference": Nullable(REFERENCE), "claimed_reference": Nullable(CLAIMED), "discount_pct": "number 0..100", "availability": STOCK, "stock_qty": Nullable("int"), "first_confirmed_at": "text", "last_confirmed_at": "text",
}
OFFER = {
    "retailer_slug": "text", "retailer_name?": "string", "url": "text", "condition": CONDITIONS, "seller_name": "text", "seller_type": SELLERS, "price_cents": "int>=0", "shipping_cents": Nullable("int"), "availability": STOCK,
    "on_clearance": "bool", "observed_at": "text",
}
POINT = {"date": "text", "retailer_slug": "text", "condition_group": SHOWN_GROUPS, "price_cents": "int>0"}
VARIANT = {"variant_pub_id": "text", "label": "text", "attributes": "object", "offers": [OFFER], "history": [POINT]}
PRODUCT = {"slug": "text", "name": "text", "brand": "text", "category": CATEGORIES, "variants": [VARIANT]}
FEED = {"generated_at": "text", "deals": [DEAL]}
META = {
    "schema_version": (2,), "export_id": "text", "generated_at": "text",
    "retailers": [{"slug": "text", "name": "text", "health": HEALTH, "last_successful_fetch_at": "text", "last_discovery_sweep_at": "text", "stale": "bool"}],
    "counts": {k: "int>=0" for k in ("products", "offers_tracked", "verified_deals", "claimed_deals", "used_deals")}, "thresholds": {"min_discount_pct": "number"}, "is_sample_data?": "bool",
}

_BROKEN = "array<struct<path:string,rule:string>>"
_BOUND = re.compile(r"(int|number)\s*(?:(>=?)\s*(-?\d+)|(-?\d+)\.\.(-?\d+))?$")


def _one(path: Column, rule: str, holds: Column) -> Column:
    """An array with the broken rule, or an empty one; a null verdict breaks nothing."""
    told = F.array(F.struct(path.alias("path"), F.lit(rule).alias("rule")))
    return F.when(~F.coalesce(holds, F.lit(True)), told).otherwise(F.array().cast(_BROKEN))


def _kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def _whole(kind: Column) -> Column:
    return (kind == "BIGINT") | kind.rlike(r"^DECIMAL\(\d+,0\)$")


def _member(value: Column, name: str) -> Column:
    return F.try_variant_get(value, f'$["{name}"]', "variant")


def _under(path: Column, step: Column) -> Column:
    return F.when(path == "", step).otherwise(F.concat(path, F.lit("."), step))


class _Levels:
    """Values that a compiled schema uses more than once, each a column of its own: ``rows`` makes them
    level by level, so that no row computes one twice. What is made at a depth can be used from the next one on."""

    def __init__(self) -> None:
        self.levels: list[dict[str, Column]] = []

    def let(self, depth: int, value: Column) -> Column:
        while len(self.levels) <= depth:
            self.levels.append({})
        name = f"v{depth}_{len(self.levels[depth])}_"
        self.levels[depth][name] = value
        return F.col(name)

    def rows(self, documents: DataFrame) -> DataFrame:
        for level in self.levels:
            documents = documents.select("*", *[value.alias(name) for name, value in level.items()])
        return documents


def broken(value: Column, schema: object, path: Column | None = None, held: _Levels | None = None, depth: int = 0, kind: Column | None = None) -> Column:
    """array<struct<path, rule>>: what of a VARIANT value breaks the schema, paths dotted, the root empty.

    Each value breaks its kind or else the finer rules; a missing key is told at its own path. A null
    (of SQL) has no verdict. With ``held`` the verdict is one on its rows, in which ``value`` is known
    at ``depth``; a function over an array's items can have no columns of its own and does without.
    """
    path = F.lit("") if path is None else path
    let = held.let if held else lambda depth, column: column
    kind = let(depth, _kind(value)) if kind is None else kind
    if isinstance(schema, Nullable):
        return F.when(kind == "VOID", F.array().cast(_BROKEN)).otherwise(broken(value, schema.of, path, held, depth, kind))
    if isinstance(schema, (dict, Closed)):
        named = schema.of if isinstance(schema, Closed) else schema
        fields = let(depth, F.try_variant_get(value, "$", "map<string,variant>"))
        parts = []
        for name, inner in named.items():
            key, optional = name.rstrip("?"), name.endswith("?")
            member, at = let(depth + 1, F.try_element_at(fields, F.lit(key))) if held else _member(value, key), _under(path, F.lit(key))
            found = let(depth + 2, _kind(member))
            parts.append(F.when(found.isNotNull(), broken(member, inner, at, held, depth + 2, found)).otherwise(F.array().cast(_BROKEN) if optional else _one(at, "required", F.lit(False))))
        if isinstance(schema, Closed):
            known = F.array(*[F.lit(k.rstrip("?")) for k in named])
            parts.append(_one(path, "extra_keys", F.size(F.array_except(F.map_keys(fields), known)) <= 0))
        return F.when(kind.startswith("OBJECT"), F.concat(*parts)).otherwise(_one(path, "type", F.lit(False)))
    if isinstance(schema, list):
        items = F.try_variant_get(value, "$", "array<variant>")
        each = F.transform(items, lambda x, i: broken(x, schema[0], _under(path, i.cast("string"))))
        return F.when(kind.startswith("ARRAY"), F.flatten(each)).otherwise(_one(path, "type", F.lit(False)))
    if isinstance(schema, tuple):
        if all(isinstance(x, int) for x in schema):
            return _one(path, "enum", F.coalesce(_whole(kind) & F.try_variant_get(value, "$", "bigint").isin(*schema), F.lit(False)))
        return _one(path, "enum", F.coalesce((kind == "STRING") & F.try_variant_get(value, "$", "string").isin(*schema), F.lit(False)))
    plain = {"text": kind == "STRING", "string": kind == "STRING", "bool": kind == "BOOLEAN", "object": kind.startswith("OBJECT")}
    if schema == "text":
        return F.when(kind == "STRING", _one(path, "empty", F.length(F.try_variant_get(value, "$", "string")) > 0)).otherwise(_one(path, "type", F.lit(False)))
    if schema in plain:
        return _one(path, "type", plain[schema])
    name, sign, bound, low, high = _BOUND.match(schema).groups()
    right = _whole(kind) if name == "int" else kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
    number = F.try_variant_get(value, "$", "double")
    holds = number > int(bound) if sign == ">" else number >= int(bound) if sign else number.between(int(low), int(high)) if low else F.lit(True)
    return F.when(right, _one(path, "bounds", holds)).otherwise(_one(path, "type", F.lit(False)))


def schema_violations(documents: DataFrame, text: str, schema: object, *keys: str) -> DataFrame:
    """(keys..., path, rule): one row for everything that breaks the schema in the JSON texts of a column.

    A text that is no JSON breaks the rule ``json`` at the root, as a null does.
    """
    held = _Levels()
    value = held.let(0, F.try_parse_json(text))
    kind = held.let(1, _kind(value))
    found = F.when(kind.isNull(), F.array(F.struct(F.lit("").alias("path"), F.lit("json").alias("rule")))).otherwise(broken(value, schema, held=held, depth=1, kind=kind))
    rows = held.rows(documents.select(*keys, text)).select(*keys, F.explode(found).alias("b_"))
    return rows.select(*keys, F.col("b_.path").alias("path"), F.col("b_.rule").alias("rule"))
