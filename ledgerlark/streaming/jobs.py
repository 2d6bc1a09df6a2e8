"""Structured Streaming jobs: windows, watermark deduplication and keyed upserts.

Jobs read the events table as a file stream. `finished` runs one to its end and gives the written result back.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.sources.workspace import shared_folder


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of files, with ts as an instant."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet*").parquet(sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))


def finished(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs the stream over all that is there; append writes files, complete replaces one table each time."""
    spark = stream.sparkSession
    folder, state = shared_folder(spark, "stream"), shared_folder(spark, "progress")
    schema = stream.schema
    if mode == "complete":
        writer = stream.writeStream.outputMode(mode).foreachBatch(lambda rows, _: rows.write.mode("overwrite").parquet(folder))
    else:
        writer = stream.writeStream.outputMode(mode).format("parquet").option("path", folder)
    writer.option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema).parquet(folder)


def tumbling(rows: DataFrame, width: str, slide: str | None = None) -> DataFrame:
    """Counts and distinct users by event type and window (sliding where `slide` is given)."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return rows.withWatermark("ts", "1 day").groupBy(w, "event_type").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,4)")).alias("total")).select(
        F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", "total")


def sessions(rows: DataFrame, gap: str) -> DataFrame:
    """Events of a user that follow each other within `gap`."""
    return rows.withWatermark("ts", "1 day").groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select(
        "user_id", F.date_format("session_window.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


def deduplicated(rows: DataFrame, keys: list[str], delay: str) -> DataFrame:
    return rows.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)


def upserting(stream: DataFrame, path: str, merge: Callable[[DataFrame | None, DataFrame], DataFrame]) -> None:
    """Every micro-batch is merged into the table at `path`, whose versions lie side by side; a batch that is run again writes its version again.

    The table is what the newest version holds; a version is written whole before the next batch can read it.
    """
    spark = stream.sparkSession

    def step(rows: DataFrame, number: int) -> None:
        stored = spark.read.parquet(f"{path}/v={number - 1}") if number else None
        merge(stored, rows).write.mode("overwrite").parquet(f"{path}/v={number}")

    stream.writeStream.foreachBatch(step).option("checkpointLocation", shared_folder(spark, "progress")).trigger(availableNow=True).start().awaitTermination()
