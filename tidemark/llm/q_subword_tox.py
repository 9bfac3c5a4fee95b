"""op2: toxicity of every document, learnt from four folds of five."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import bounded_sample, fold, table
from .subword_tox import DOCS_PER_CLASS, fit, score_documents

NAME = "op2_subword_toxicity"
FOLDS, HELD_OUT = 5, 0


def training_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, float]:
    """Labelled documents outside the held-out fold, and the ratio of toxic to other labels there.

    A document labelled both ways is left out. Labels are drawn before their documents are looked up
    (at most DOCS_PER_CLASS, so their broadcast is bounded and no text is shuffled).
    """
    labels = (
        table(spark, sf_dir, "labels")
        .where("toxic in (0, 1) and doc_id is not null")
        .where(fold(F.col("doc_id"), FOLDS) != HELD_OUT)
        .groupBy("doc_id")
        .agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most"))
        .where("toxic = most")
        .select("doc_id", "toxic")
    )
    counts = dict(labels.groupBy("toxic").count().collect())
    drawn = bounded_sample(labels, "toxic", counts, DOCS_PER_CLASS)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.join(F.broadcast(drawn), "doc_id"), counts.get(1, 0) / max(1, counts.get(0, 0))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = fit(*training_rows(spark, sf_dir))
    found = score_documents(table(spark, sf_dir, "documents"), model)
    return found.select(
        "doc_id",
        (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
