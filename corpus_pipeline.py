"""From raw documents to token ids in five stages.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and its result is
written and read again as the next one's docs. All but the last keep the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import byte_bpe, decontaminate, gru_lang, near_copies, q_byte_bpe, q_gru_lang, secret_forest
from tidemark.llm.shared import cut, fresh, table, text_mark, written

#: Documents whose language is less sure are rejected, as are those without a letter.
LEAST_SURE = 0.3


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the network tells; null texts, texts without letters and texts in
    none of the learnt languages go."""
    net = gru_lang.fit(q_gru_lang.training_rows(docs))
    named = fresh(docs, "lang_pred"), fresh(docs, "lang_score")
    found = gru_lang.identify(docs, net, tuple(docs.columns), named)
    return found.where((F.col(named[0]) != gru_lang.UNDETERMINED) & (F.col(named[1]) >= LEAST_SURE)).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates, every row that has none.

    Candidates come from SimHash fingerprints of five-word shingles, and from an exact join for what
    those leave apart. Near-duplicates have a Jaccard similarity of 0.8 or more; ids play no
    part in that, so rows that share an id or have none stay if their texts differ. Of a group the
    row with the least doc_id stays (one without id only if none has one), then the least text, then
    the least of the other columns. Null, empty and wordless texts are one group.
    """
    marked = cut(near_copies.near_copies(docs))
    kept, mark, again = fresh(docs, "kept_id"), fresh(docs, "mark"), fresh(docs, "n_rows")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")
    sized = marked.groupBy("component", "doc_id", "mark").agg(F.count("*").alias("n"))
    first = sized.groupBy("component").agg(F.min_by(F.struct("doc_id", "mark", "n"), order).alias("f"))
    first = cut(first.select(F.col("f.doc_id").alias(kept), F.col("f.mark").alias(mark), F.col("f.n").alias(again)))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(kept)) & (text_mark(F.col("text")) == F.col(mark))
    rows = docs.join(first, same)
    if first.where(F.col(again) > 1).isEmpty():
        return rows.select(*docs.columns)
    single = rows.where(F.col(again) == 1).select(*docs.columns)
    least = F.min(F.struct(*[F.col(c).alias(f"c{k}") for k, c in enumerate(docs.columns)]))
    repeated = rows.where(F.col(again) > 1).groupBy(kept, mark).agg(least.alias("row"))
    return single.unionByName(repeated.select(*[F.col(f"row.c{k}").alias(c) for k, c in enumerate(docs.columns)]))


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no test item."""
    return decontaminate.without_benchmark(docs, table(spark, sf_dir, "benchmark"))


def remove_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced; n_chars follows the text."""
    clean = secret_forest.redact(docs, secret_forest.fit(secret_forest.labelled_findings(spark)))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        clean = clean.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast(kind)))
    return clean.select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text for every document."""
    return byte_bpe.encode_digests(docs, public_tokenizers.path(q_byte_bpe.VOCABULARY))


STAGES = [
    ("language_id", identify_language),
    ("simhash_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_benchmark),
    ("secret_scan", remove_secrets),
    ("bpe_encode", encode),
]

#: No SQL: a trained network and a trained forest take part. tests/llm holds a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
