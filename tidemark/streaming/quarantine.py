"""Batches whose bad rows are set aside with their reason while the good ones go on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: The name under which a stream's counts are observed.
COUNTS = "quarantine"


def store_split(batch: DataFrame, batch_id: int, store: str) -> None:
    """Stores a batch under its number, good and bad rows apart (``accepted``); a rerun writes over itself."""
    batch.write.mode("overwrite").partitionBy("accepted").parquet(f"{store}/batch={batch_id}")


def start_split(stream: DataFrame, reason: Column, store: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Runs a stream into a store of accepted rows and dead letters with ``reason`` (null: accepted).

    ``reason`` must be a total expression (try_ functions), so that no row's contents can stop a
    batch. How many rows were seen and set aside is observed on the way, without another pass.
    """
    split = stream.withColumn("reason", reason).withColumn("accepted", F.col("reason").isNull())
    counted = split.observe(COUNTS, F.count("*").alias("seen"), F.count_if(~F.col("accepted")).alias("set_aside"))
    writer = counted.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, n: store_split(batch, n, store))
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start()


def counts(query: StreamingQuery) -> dict[str, int]:
    """What the stream observed so far: rows seen and rows set aside."""
    found = [p.observedMetrics[COUNTS] for p in query.recentProgress if COUNTS in (p.observedMetrics or {})]
    return {"seen": sum(m.seen for m in found), "set_aside": sum(m.set_aside for m in found)}


def stored_split(spark, store: str) -> DataFrame:
    """All rows of a store, with ``accepted`` and ``reason``."""
    return spark.read.option("basePath", store).parquet(f"{store}/batch=*").withColumn("accepted", F.col("accepted").cast("boolean"))
