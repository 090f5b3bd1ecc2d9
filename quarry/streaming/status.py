"""Incremental ingestion: the status of documents as a stream of events, folded into a table of states."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quarry.operators import catalog


def read_events(spark: SparkSession, folder: str, schema: str = "event_id long, ts timestamp, user_id long, event_type string, value double, props string") -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def running_status(events: DataFrame, cancelled: DataFrame | None = None) -> DataFrame:
    """The fold of catalog.status_fold as a stream (output mode complete or update); events of cancelled documents are left out."""
    if cancelled is not None:
        events = events.join(cancelled.select(F.col("document_id").alias("user_id")), "user_id", "left_anti")
    return catalog.status_fold(events)


def windowed(events: DataFrame, size: str = "1 hour", late: str = "30 minutes") -> DataFrame:
    """Events by type and window of event time; state is kept until the watermark passes."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))


def start(events: DataFrame, table: str, checkpoint: str, cancelled: DataFrame | None = None):
    """Starts the stream into a table of Parquet snapshots, written anew for each batch."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch={number}")

    return running_status(events, cancelled).writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(put).trigger(availableNow=True).start()
