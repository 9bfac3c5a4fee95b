"""Calendar days and time texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EASTERN = "America/New_York"


def eastern_day(instant: Column) -> Column:
    """US Eastern calendar day of a UTC instant."""
    return F.to_date(F.from_utc_timestamp(instant, EASTERN))


def iso_z(instant: Column) -> Column:
    return F.date_format(F.date_trunc("second", instant), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def minute_bucket(instant: Column) -> Column:
    return F.date_format(instant, "yyyy-MM-dd'T'HH:mm")


def ago_text(then: Column, now: Column) -> Column:
    """``n min ago``, ``n h ago`` or ``n d ago``."""
    seconds = F.unix_timestamp(now) - F.unix_timestamp(then)
    n = lambda unit: F.floor(seconds / unit).cast("bigint").cast("string")
    return (
        F.when(seconds < 60, F.lit("just now"))
        .when(seconds < 3600, F.concat(n(60), F.lit(" min ago")))
        .when(seconds < 86400, F.concat(n(3600), F.lit(" h ago")))
        .otherwise(F.concat(n(86400), F.lit(" d ago")))
    )
