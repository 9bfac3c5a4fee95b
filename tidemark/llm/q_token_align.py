"""op13: groups, links and corpus-wide link counts of two tokenizers over all documents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .shared import table
from .token_align import align_digests

NAME = "op13_token_align"
FIRST, SECOND = "byte_bpe_50k.json", "piece_bpe_32k.model"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_digests(table(spark, sf_dir, "documents"), public_tokenizers.path(FIRST), public_tokenizers.path(SECOND))
