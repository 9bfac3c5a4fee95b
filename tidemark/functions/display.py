"""Texts for people."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def percent_text(bp: Column) -> Column:
    """Basis points as a percentage with one decimal, which is dropped if it is 0."""
    tenths = F.round(bp / 10).cast("bigint")
    part = tenths % 10
    whole = F.floor(tenths / 10).cast("bigint").cast("string")
    return F.concat(whole, F.when(part == 0, "").otherwise(F.concat(F.lit("."), part.cast("string"))), F.lit("%"))


def title_of_slug(slug: Column) -> Column:
    return F.initcap(F.replace(slug, F.lit("-"), F.lit(" ")))


def repaired_name(name: Column, slug: Column) -> Column:
    """The name, or the slug's title where the name is blank or a placeholder."""
    plain = F.lower(F.trim(F.coalesce(name, F.lit(""))))
    return F.when(plain.isin("", "unknown", "default title", "n/a"), title_of_slug(slug)).otherwise(F.trim(name))


def days_text(days: Column) -> Column:
    return F.when(days == 1, F.lit("1 day")).otherwise(F.concat(days.cast("string"), F.lit(" days")))
