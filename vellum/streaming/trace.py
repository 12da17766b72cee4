"""Trace events: an append-only table, written row by row or as a stream, and stateful reads of it."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

TRACE = "timestamp timestamp, event string, run_id string, payload string"


def emit(spark: SparkSession, path: str, event: str, run_id: str, payload: dict, timestamp: str) -> None:
    """Append one event as a JSON line."""
    row = spark.createDataFrame([(timestamp, event, run_id, json.dumps(payload, ensure_ascii=False, sort_keys=True))], "timestamp string, event string, run_id string, payload string")
    row.withColumn("timestamp", F.col("timestamp").cast("timestamp")).coalesce(1).write.mode("append").json(path)


def read_stream(spark: SparkSession, path: str, schema: str = TRACE, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(path)


def write_stream(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """All events that are there, appended as Parquet; each exactly once over restarts."""
    return events.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(path)


def windowed_counts(events: DataFrame, time: str = "timestamp", width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Events per window and kind; rows later than the watermark allows are left out."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), "event").agg(F.count("*").alias("n"))


def upsert_stream(events: DataFrame, path: str, checkpoint: str, key: str = "run_id", order: str = "timestamp") -> StreamingQuery:
    """The newest event of each key of every batch, appended under its batch number, so that a repeated batch replaces
    itself; :func:`vellum.operators.tabular.latest` over the table is its current state."""
    from vellum.operators.tabular import latest

    def each(batch: DataFrame, number: int) -> None:
        latest(batch, key, order).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return events.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def cap_actions(events: DataFrame, most: int) -> DataFrame:
    """``run_id, actions, over``: how many actions a run took and whether it went over its budget, as a running total."""
    return events.where("event = 'action'").groupBy("run_id").agg(F.count("*").alias("actions")).withColumn("over", F.col("actions") > most)
