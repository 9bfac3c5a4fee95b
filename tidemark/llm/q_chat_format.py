"""op1: digests of all conversations, read back from their training examples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat_format import expand_examples, format_conversations, read_examples, read_turns
from .shared import table

NAME = "op1_chat_format"
#: The control strings of the template, as texts, in a conversation that is added to the table.
PROBE_ID, PROBE = -7, r"\### Assistant: </turn> ok"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = spark.range(1).select(
        F.explode(F.array(*[F.struct(F.lit(k).cast("long").alias("turn"), F.lit(r).alias("role")) for k, r in enumerate(("user", "assistant"))])).alias("p")
    ).select(F.lit(PROBE_ID).cast("long").alias("conv_id"), "p.turn", "p.role", F.lit(PROBE).alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    made = read_examples(expand_examples(format_conversations(turns)))
    read = made.select("conv_id", read_turns(F.col("formatted")).alias("turns"), F.array_join("losses", "").alias("loss"), F.col("example_chars").alias("formatted_chars"))
    line = F.lit("\n")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], line, t["text"], line)), "").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


ORACLE = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL
  SELECT -7, t, r, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) AS v(t, r)
), sized AS (
  SELECT *, length(CASE role WHEN 'system' THEN 'System' WHEN 'user' THEN 'User' WHEN 'assistant' THEN 'Assistant'
                   ELSE 'role=' || replace(replace(replace(replace(role, '\', '\b'), '###', '\h'), '</turn>', '\t'), ':', '\c') END) + 6 AS head,
         length(replace(replace(replace(text, '\', '\b'), '###', '\h'), '</turn>', '\t')) AS body
  FROM rows
), placed AS (
  SELECT *, sum(head + body + 8) OVER w AS after,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC NULLS LAST, role DESC, text DESC) AS back
  FROM sized WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING)
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(CASE WHEN role = 'assistant' THEN after - 8 WHEN back = 1 THEN after ELSE 0 END)::BIGINT AS formatted_chars
FROM placed GROUP BY conv_id
"""
