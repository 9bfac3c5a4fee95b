"""op12: conversations are damaged by a rule and repaired at the least cost."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table
from .turn_repair import repair_report

NAME = "op12_turn_repair"
_NOTHING = hashlib.sha256(b"").hexdigest()


def damaged(turns: DataFrame) -> DataFrame:
    """The rows after damage, which crc32 of ``conv_id:turn`` modulo 20 decides: 0 drops a row, 1 empties
    its text, 2 takes its marks of sentence ends, 3 repeats it, 4 makes it the user's. Nulls are one space."""
    named = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    rows = turns.select("conv_id", "turn", *[F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")], (F.crc32(F.concat_ws(":", *named).cast("binary")) % 20).alias("fate"))
    fate = F.col("fate")
    text = F.when(fate == 1, "").when(fate == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(fate == 4, "user").otherwise(F.col("role"))
    times = F.when(fate == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.where(fate != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("time")).drop("time")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    report = repair_report(damaged(turns)).withColumnRenamed("conv_id", "repaired_id")
    every = turns.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    joined = every.join(report, F.col("conv_id").eqNullSafe(F.col("repaired_id")), "left")
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return joined.select("conv_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(_NOTHING)).alias("repaired_sha256"))
