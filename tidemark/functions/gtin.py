"""Article numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_gtin(raw: Column) -> Column:
    """The 14 digits of a valid GTIN of 8, 12, 13 or 14 digits, else null."""
    digits = F.regexp_replace(raw, r"\D", "")
    padded = F.lpad(digits, 14, "0")
    weighted = F.aggregate(
        F.sequence(F.lit(1), F.lit(13)),
        F.lit(0),
        lambda total, i: total + F.substring(padded, i, F.lit(1)).try_cast("int") * F.when(i % 2 == 1, 3).otherwise(1),
    )
    check = (F.lit(10) - weighted % 10) % 10
    fits = F.length(digits).isin(8, 12, 13, 14) & (F.substring(padded, 14, 1).try_cast("int") == check)
    return F.when(fits, padded)


def normalize_all(raw: Column) -> Column:
    """Valid GTINs of an array, first-seen order, each once."""
    return F.array_distinct(F.array_compact(F.transform(raw, normalize_gtin)))
