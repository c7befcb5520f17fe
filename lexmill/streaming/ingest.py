"""Continuous ingest of chunk tables into a store: each micro-batch is one upsert by file, so a replayed batch changes nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexmill.operators import index


def stream_chunks(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Rows of parquet files as they arrive in a folder."""
    return spark.readStream.schema(schema).parquet(folder)


def ingest(rows: DataFrame, store: index.Store, checkpoint: str, now: str) -> StreamingQuery:
    """Upserts a stream of chunk rows (``id, document, source_file, content_hash, ...``) until the source is drained."""

    def apply(batch: DataFrame, number: int) -> None:
        files = batch.groupBy("source_file").agg(F.max("content_hash").alias("content_hash"), F.sum(F.octet_length("document")).alias("file_size"))
        changes = index.classify(files, store.manifest())
        fresh = batch.drop("content_hash")
        store.apply(fresh, changes, index.new_manifest(store.manifest(), changes, fresh, F.lit(now)))

    return rows.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counts_by_window(rows: DataFrame, time: str = "loaded_at", late: str = "3 days", size: str = "1 day") -> DataFrame:
    """Chunks of each type and window of arrival; rows later than ``late`` are past the watermark."""
    return rows.withWatermark(time, late).groupBy(F.window(time, size), "clause_type").agg(F.count("*").alias("n")).select("window.start", "clause_type", "n")
