"""Structured Streaming over events and captures: windows, idempotent merges, incremental edits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, folder: str, name: str, schema) -> DataFrame:
    """The Parquet files of one name in a folder, as a stream."""
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)


def tumbling(events: DataFrame, ts: str, width: str, late: str, *keys: str) -> DataFrame:
    """Counts by window; rows that come more than ``late`` behind are dropped."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))


def sessions(events: DataFrame, ts: str, gap: str, late: str, *keys: str) -> DataFrame:
    return events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))


def once(events: DataFrame, key: str, ts: str, late: str) -> DataFrame:
    """Each id once: a repeated event changes nothing."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """All that is there now, written to Parquet at ``path`` and read back. In complete mode the last result stays."""
    if mode == "append":
        q = stream.writeStream.format("parquet").option("path", path)
    else:
        q = stream.writeStream.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(path))
    q.option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.parquet(path)
