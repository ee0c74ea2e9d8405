"""Continuous arrival: events counted by the hour, findings appended once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def hourly(events: DataFrame, late: str | None = None) -> DataFrame:
    """Events by hour and type, of a table or a stream; with `late`, events later than that are dropped and hours end."""
    if late is not None:
        events = events.withWatermark("ts", late)
    n = events.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n_events"), F.round(F.sum("value"), 6).alias("sum_value"))
    return n.select(F.col("w.start").alias("hour"), "event_type", "n_events", "sum_value")


def files_of(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    """A stream of the parquet files that come into a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def once(findings: DataFrame, ts: str, keys: list[str], late: str) -> DataFrame:
    """Findings of a stream without those delivered again within `late`."""
    return findings.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def append_to(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Append a stream's rows to a folder, exactly once, until what is there now is read."""
    return stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def merge_into(stream: DataFrame, folder: str, checkpoint: str, keys: list[str]) -> StreamingQuery:
    """Write each batch's rows once by keys; a batch that is run again overwrites itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.dropDuplicates(keys).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
