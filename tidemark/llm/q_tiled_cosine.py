"""op9: near-duplicate links and components of all embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .shared import table
from .tiled_cosine import near_duplicates

NAME = "op9_embedding_dedup"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


#: All pairs of a label, which only the small scale can afford.
ORACLE = """
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS k, vec_id, embedding::DOUBLE[] AS e, label FROM embeddings
), fine AS (
  SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND list_bool_and(list_transform(e, lambda x: coalesce(isfinite(x), FALSE))) AND list_bool_or(list_transform(e, lambda x: x <> 0))
), links AS (
  SELECT a.k AS a, b.k AS b FROM fine a JOIN fine b ON a.label = b.label AND a.k <> b.k AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), reach AS (
  SELECT k AS a, k AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), least AS (SELECT r.a, min(v.vec_id) AS component_id FROM reach r JOIN v ON v.k = r.b GROUP BY r.a)
SELECT vec_id, (SELECT count(*) FROM links l WHERE l.a = v.k) AS n_links, component_id, coalesce(vec_id = component_id, FALSE) AS kept FROM v JOIN least ON least.a = v.k
"""
