"""Watermarked windows, sessions, de-duplication and a keyed running state over streams."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def event_stream(spark: SparkSession, folder: str, glob: str, schema: T.StructType, most_files: int | None = None) -> DataFrame:
    """The Parquet files of a folder, as a stream."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    return (reader.option("maxFilesPerTrigger", most_files) if most_files else reader).parquet(folder)


def _timed(events: DataFrame, time: str, late: str) -> DataFrame:
    """Streaming windows need instants; zone-less times are read in the session's zone."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)


def windowed(events: DataFrame, time: str, length: str, slide: str | None, keys: list[str], late: str, **aggregates) -> DataFrame:
    """Tumbling windows, or sliding ones with slide: start, end, keys and the aggregates."""
    span = F.window(time, length, slide) if slide else F.window(time, length)
    out = _timed(events, time, late).groupBy(span.alias("w"), *keys).agg(*[c.alias(n) for n, c in aggregates.items()])
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, *aggregates)


def sessions(events: DataFrame, time: str, gap: str, keys: list[str], late: str, **aggregates) -> DataFrame:
    """Windows that end after gap without an event of the key."""
    out = _timed(events, time, late).groupBy(F.session_window(time, gap).alias("w"), *keys).agg(*[c.alias(n) for n, c in aggregates.items()])
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, *aggregates)


def deduplicated(events: DataFrame, time: str, keys: list[str], late: str) -> DataFrame:
    """The first event of each key within the watermark."""
    return _timed(events, time, late).dropDuplicatesWithinWatermark(keys)


def running_totals(events: DataFrame, key: str, value: str) -> DataFrame:
    """key, n and total so far, for each key of each batch: a state of two numbers a key."""
    kind = events.schema[key].dataType
    out = T.StructType([T.StructField(key, kind), T.StructField("n", T.LongType()), T.StructField("total", T.DoubleType())])
    state = T.StructType([T.StructField("n", T.LongType()), T.StructField("total", T.DoubleType())])

    def update(keys: tuple, frames: Iterator, held) -> Iterator:
        import pandas as pd

        n, total = held.get if held.exists else (0, 0.0)
        for f in frames:
            n, total = n + int(f[value].count()), total + float(f[value].sum())
        held.update((n, total))
        yield pd.DataFrame({key: [keys[0]], "n": [n], "total": [total]})

    return events.groupBy(key).applyInPandasWithState(update, out, state, "update", "NoTimeout")


def run_available(stream: DataFrame, sink: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Process what is there now into Parquet files at sink, exactly once per checkpoint, and read
    them."""
    query = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).option("path", sink).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(sink)


def run_to_batches(stream: DataFrame, sink: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """For modes that files lack: each batch replaces what is at sink."""

    def put(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(sink)

    query = stream.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(sink)
