"""op8: BPE ids and their decoding for all documents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .byte_bpe import encode_digests
from .shared import table

NAME = "op8_byte_bpe"
VOCABULARY = "byte_bpe_50k.json"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))
