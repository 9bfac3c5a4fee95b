"""op4: class-based n-gram scores of all documents, learnt from six folds of seven."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .brown_lm import score_documents
from .shared import fold, table

NAME = "op4_brown_lm"
FOLDS, HELD_OUT = 7, 2


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_documents(docs.withColumn("held_out", fold(F.col("doc_id"), FOLDS) == HELD_OUT))
