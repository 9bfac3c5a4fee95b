"""Latest row of each group, keyed merges and overlap joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_by(df: DataFrame, keys: list[str], order: list[Column], keep: int = 1) -> DataFrame:
    """The first ``keep`` rows of each group in a total order (WindowGroupLimit trims before the shuffle)."""
    return ranked_by(df, keys, order, keep).drop("rank_")


def ranked_by(df: DataFrame, keys: list[str], order: list[Column], keep: int) -> DataFrame:
    """As ``latest_by``, with the place in the group as ``rank_``."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("rank_", rank).where(F.col("rank_") <= keep)


def array_overlap_join(left: DataFrame, right: DataFrame, key: str, left_id: str, right_id: str) -> DataFrame:
    """(left_id, right_id): for each left row the least right row that shares an element of the array ``key``.

    Arrays are exploded and joined on their elements; the right side is reduced to one row for each
    element first, so an element that very many rows share costs each left row one match.
    """
    a = left.select(left_id, F.explode(F.array_distinct(key)).alias("element_"))
    b = right.select(right_id, F.explode(F.array_distinct(key)).alias("element_")).groupBy("element_").agg(F.min(right_id).alias(right_id))
    return a.join(b, "element_").groupBy(left_id).agg(F.min(right_id).alias(right_id))


def keyed_merge(current: DataFrame, batch: DataFrame, keys: list[str], rules: dict[str, Column]) -> DataFrame:
    """Upsert of a batch (one row for each key) into a current table.

    ``rules`` gives each other column of the result as an expression over ``c.`` (current) and
    ``b.`` (batch) columns of the full outer join; a side without the key is null.
    """
    same = reduce(lambda x, y: x & y, [F.col(f"c.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys])
    both = current.alias("c").join(batch.alias("b"), same, "full_outer")
    return both.select(*[F.coalesce(F.col(f"c.{k}"), F.col(f"b.{k}")).alias(k) for k in keys], *[e.alias(n) for n, e in rules.items()])


def unseen(batch: DataFrame, stored: DataFrame, keys: list[str], order: list[Column], open_ended: Column | None = None) -> DataFrame:
    """Rows of a batch whose key is neither stored nor earlier in the batch.

    Rows for which ``open_ended`` holds are never taken as seen.
    """
    never = F.lit(False) if open_ended is None else F.coalesce(open_ended, F.lit(True))
    fresh = latest_by(batch.where(~never), keys, order).join(stored.select(*keys).distinct(), keys, "left_anti")
    return fresh.unionByName(batch.where(never))
