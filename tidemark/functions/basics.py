"""Small helpers that build Columns."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def lookup(table: Mapping[str, object], key: Column, default: Column | None = None) -> Column:
    """The value of ``key`` in a small fixed table; default (or null) if it has none."""
    known = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    found = F.try_element_at(known, key)
    return found if default is None else F.coalesce(found, default)


def blank_to_null(text: Column) -> Column:
    trimmed = F.trim(text)
    return F.when(trimmed != "", trimmed)


def first_reason(pairs: list[tuple[str, Column]]) -> Column:
    """The name of the first condition that holds, or null."""
    out = F.lit(None).cast("string")
    for name, holds in reversed(pairs):
        out = F.when(holds, F.lit(name)).otherwise(out)
    return out


def reasons(pairs: list[tuple[str, Column]]) -> Column:
    """The names of all conditions that hold, in order."""
    return F.array_compact(F.array(*[F.when(holds, F.lit(name)) for name, holds in pairs]))


def group(text: Column, pattern: str, number: int = 1) -> Column:
    """A regex group, null where the pattern does not occur."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, number))
