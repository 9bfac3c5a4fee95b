"""op3: the benchmark items that documents contain, one row for each pair."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .decontaminate import contamination
from .shared import table

NAME = "op3_benchmark_decontamination"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
