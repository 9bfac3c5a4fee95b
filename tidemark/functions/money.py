"""Prices as integer cents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .basics import group

PRICE = r"\$?\s*(\d[\d,]*)(\.\d{1,2})?"


def parse_price_cents(text: Column) -> Column:
    """Cents of the first price-like number in a text; null if there is none or it is not above 0."""
    whole = F.regexp_replace(group(text, PRICE), ",", "")
    part = F.rpad(F.regexp_replace(F.regexp_extract(text, PRICE, 2), r"\.", ""), 2, "0")
    cents = whole.try_cast("bigint") * 100 + F.coalesce(part.try_cast("bigint"), F.lit(0))
    return F.when(cents > 0, cents)


def format_cents(cents: Column) -> Column:
    return F.concat(F.lit("$"), F.floor(cents / 100).cast("bigint").cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))


def dollars_to_cents(amount: Column) -> Column:
    """Cents of a numeric amount, ties to even; null unless above 0."""
    cents = F.bround(amount.cast("double") * 100, 0).cast("bigint")
    return F.when(cents > 0, cents)


def landed_cents(price: Column, shipping: Column) -> Column:
    """Price with shipping; null if shipping is unknown."""
    return price + shipping


def comparable_cents(price: Column, shipping: Column) -> Column:
    """Landed price where shipping is known, the item price elsewhere."""
    return F.coalesce(price + shipping, price)


def discount_bp(price: Column, reference: Column) -> Column:
    """Discount in basis points, rounded; 0 where the reference is not above 0."""
    raw = F.round((reference - price) * F.lit(10000.0) / reference).cast("bigint")
    return F.when(reference > 0, raw).otherwise(F.when(reference.isNotNull(), F.lit(0).cast("bigint")))
