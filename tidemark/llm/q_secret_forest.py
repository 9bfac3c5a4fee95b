"""op6: secret candidates of all documents and the forest's verdict on each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .secret_forest import fit, labelled_findings, scan
from .shared import table

NAME = "op6_secret_forest"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"), fit(labelled_findings(spark)))
    return found.select(
        "doc_id", "start", F.length("candidate").alias("n_chars"), F.sha2(F.col("candidate").cast("binary"), 256).alias("candidate_sha256"), "probability", "is_secret"
    )
