"""op11: main text of all pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .page_text import extract_main_text
from .shared import table

NAME = "op11_page_text"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))
