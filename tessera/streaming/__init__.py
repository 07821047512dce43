"""Structured Streaming: continuous ingest, rate limits as state, and windowed rates."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.tenancy import bucket_function
from tessera.sources.loaders import Registry, _parsed, _wanted

BINARY = "path string, modificationTime timestamp, length long, content binary"


def directory_stream(spark: SparkSession, path: str, registry: Registry | None = None, excluded: Sequence[str] = ()) -> DataFrame:
    """Documents of files as they appear in a folder."""
    registry = registry or Registry.default()
    files = spark.readStream.format("binaryFile").schema(BINARY).option("recursiveFileLookup", "true").load(path)
    return _parsed(files.where(_wanted(F.col("path"), list(registry.loaders), excluded, path)), registry)


def ingest(stream: DataFrame, chunker: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str):
    """Chunks of a stream of documents into a Parquet folder, exactly once; what is there is taken, then it ends."""
    return chunker(stream).writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start(sink)


def rates(events: DataFrame, ts: str = "ts", by: Sequence[str] = (), width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events in tumbling windows; an extension. The time is cast, as a watermark needs a timestamp with a zone."""
    timed = events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    return timed.groupBy(F.window("_ts", width), *by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *by, "n")


def rate_limited(events: DataFrame, key: str, capacity: float, per_second: float) -> DataFrame:
    """(event_id, key, allowed): a token bucket for each key, kept as state. events: event_id, ts and the key."""
    timed = events.select(F.col(key).cast("string").alias("key"), "event_id", F.col("ts").cast("timestamp").alias("ts"))
    return timed.groupBy("key").applyInPandasWithState(bucket_function(capacity, per_second), "event_id long, key string, allowed boolean", "tokens double, last double", "append", "NoTimeout")
