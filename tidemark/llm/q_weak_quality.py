"""op5: quality of every document from a weak-label model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .shared import table
from .weak_quality import fit, score_quality

NAME = "op5_weak_label_quality"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, fit(docs))
