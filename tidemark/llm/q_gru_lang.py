"""op10: the language of every document, learnt from two folds of three."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .gru_lang import fit, identify
from .shared import fold, table

NAME = "op10_gru_lang_id"
FOLDS, HELD_OUT = 3, 1


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.where(fold(F.col("doc_id"), FOLDS) != HELD_OUT).select("doc_id", "text", "lang")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), fit(training_rows(docs)))
    return found.select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "lang_pred", "score")
