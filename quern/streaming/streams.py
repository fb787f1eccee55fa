"""Structured Streaming jobs: incremental ingest, live windows, exactly-once sinks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def ingest(spark: SparkSession, source: str, schema: T.StructType, target: str, checkpoint: str, prepare: Callable[[DataFrame], DataFrame] = lambda df: df, file_format: str = "parquet") -> StreamingQuery:
    """Files that appeared since the last run, prepared and appended once each; the checkpoint is the list of files done.

    Runs what is there and stops, so a scheduler can call it again; a run that fails half-way is repeated whole.
    """
    stream = spark.readStream.schema(schema).format(file_format).option("maxFilesPerTrigger", 1000).load(source)
    return prepare(stream).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_windows(stream: DataFrame, ts: str, late: str, width: str, *keys: str) -> DataFrame:
    """Tumbling counts of events at most ``late`` behind; state of closed windows is dropped."""
    rows = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return rows.groupBy(F.window(ts, width).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def sessions(stream: DataFrame, ts: str, late: str, gap: str, *keys: str) -> DataFrame:
    """Session windows by key (a stream needs one): a gap ends a session."""
    rows = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return rows.groupBy(F.session_window(ts, gap).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


def distinct_events(stream: DataFrame, ts: str, late: str, *keys: str) -> DataFrame:
    """Each key once within the watermark."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).dropDuplicatesWithinWatermark(list(keys))


def to_sink(stream: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None], mode: str = "append") -> StreamingQuery:
    """Micro-batches to a function of (rows, batch number), which must write a batch number once (say, to a folder of that name)."""
    return stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
