"""Bounded-memory ingest of arriving files with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varloom.operators.pipe import Pipe, identity


def ingest_new_files(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, files_per_batch: int = 64, pipe: Pipe = identity, file_format: str = "csv", options: dict[str, str] | None = None) -> None:
    """Appends files not seen before to a Parquet table, some files at a time, and stops. What a checkpoint has seen is never read again.

    `checkpoint` is a shared folder. A value that does not fit the schema raises.
    """
    reader = spark.readStream.schema(schema).format(file_format).option("maxFilesPerTrigger", files_per_batch).option("mode", "FAILFAST")
    for k, v in (options or {}).items():
        reader = reader.option(k, v)
    query = reader.load(source).transform(pipe).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def windowed_counts(events: DataFrame, time: str, keys: list[str], window: str, late: str) -> DataFrame:
    """Rows and sum of `value` per key and time window; rows later than `late` behind the newest are left out in a stream."""
    return events.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), *keys, "n", "total")


def run_available(df: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Runs a stream over what is there now, giving each batch to `sink`."""
    df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start().awaitTermination()
