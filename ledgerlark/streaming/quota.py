"""A daily quota by event time: each user's best events of a day, decided when the watermark closes the day.

What is kept of a user and day is at most `limit` candidates and the events that a ledger has reserved before. Rows only compete, so
it does not matter how they fall into micro-batches. Each micro-batch is ranked together with what open days have kept, as one plan of
joins and windows, and written as the next version; closed days leave it as results. The watermark runs over the ends of days, so a row
is late only when its whole day is closed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlark.sources.workspace import shared_folder

OUT = "user_id long, day string, event_id long, status string"
KEPT = "user_id long, day string, day_end timestamp, event_id long, value double, held boolean, seen boolean"
DAY = ["user_id", "day"]
#: Before and after all days, in microseconds as all marks are.
BEGIN, END = -(2**62), 2**62


def dated(rows: DataFrame) -> DataFrame:
    """Rows (user_id, event_id, value, ts) as candidates. A null user, instant or id takes no part."""
    return rows.where("user_id is not null and ts is not null and event_id is not null").select(
        F.col("user_id").cast("long").alias("user_id"), F.date_format("ts", "yyyy-MM-dd").alias("day"), (F.date_trunc("day", "ts") + F.expr("interval 1 day")).alias("day_end"),
        F.col("event_id").cast("long").alias("event_id"), F.col("value").cast("double").alias("value"), F.lit(False).alias("held"), F.lit(True).alias("seen"))


def reserved(ledger: DataFrame) -> DataFrame:
    """What a ledger (user_id, day, event_id) has reserved; its events pass without taking a place again."""
    return ledger.select("user_id", "day", (F.col("day").cast("timestamp") + F.expr("interval 1 day")).alias("day_end"), "event_id", F.lit(None).cast("double").alias("value"), F.lit(True).alias("held"), F.lit(False).alias("seen")).distinct()


def kept(rows: DataFrame, limit: int) -> DataFrame:
    """Of each user and day the best `limit` events by value, then id, and all reserved ones; an event counts once."""
    once = rows.groupBy(*DAY, "day_end", "event_id").agg(F.max("value").alias("value"), F.bool_or("held").alias("held"), F.bool_or("seen").alias("seen"))
    place = F.row_number().over(Window.partitionBy(*DAY).orderBy(F.desc("value"), "event_id"))
    best = once.where("not held").withColumn("_n", place).where(F.col("_n") <= limit).drop("_n")
    return best.unionByName(once.where("held"))


def decided(rows: DataFrame, limit: int) -> DataFrame:
    """user_id, day, event_id and status (queued, or reserved by the ledger and met again) of closed days."""
    taken = F.count_if("held").over(Window.partitionBy(*DAY))
    place = F.row_number().over(Window.partitionBy(*DAY).orderBy("held", F.desc("value"), "event_id"))
    ranked = rows.withColumn("_taken", taken).withColumn("_n", place)
    status = F.when(F.col("held") & F.col("seen"), "reserved").when(~F.col("held") & (F.col("_n") <= limit - F.col("_taken")), "queued")
    return ranked.select(*DAY, "event_id", status.alias("status")).where("status is not null")


class QuotaRun:
    """A quota over a folder of files that goes on from where it stopped: `more` takes in what has come, `closing` ends all days."""

    def __init__(self, spark: SparkSession, source: DataFrame, limit: int, delay: str, ledger: DataFrame | None = None):
        self.spark, self.limit, self.delay = spark, limit, delay
        self.source = source.select("user_id", "event_id", "value", "ts")
        self.state, self.out, self.progress = (shared_folder(spark, k) for k in ("kept", "quota", "progress"))
        # by (batch, number of the step after it): folder of what is kept, the watermark then and the last end of a day seen
        self.versions = {(-1, 0): (None if ledger is None else f"{self.state}/ledger", BEGIN, BEGIN)}
        if ledger is not None:
            reserved(ledger).write.parquet(f"{self.state}/ledger")

    def _open(self, before: tuple) -> tuple[DataFrame, int, int]:
        folder, mark, last = self.versions[max(k for k in self.versions if k < before)]
        rows = self.spark.createDataFrame([], KEPT) if folder is None else self.spark.read.schema(KEPT).parquet(folder)
        return rows.where(f"unix_micros(day_end) > {mark}"), mark, last

    def _until(self, last: int) -> int:
        """The watermark after a day's end `last` was seen."""
        return last if last == BEGIN else self.spark.range(1).select(F.unix_micros(F.timestamp_micros(F.lit(last)) - F.expr(f"interval {self.delay}"))).first()[0]

    def _write(self, key: tuple, rows: DataFrame, mark: int, last: int) -> None:
        name = f"{key[0]}-{key[1]}"
        rows.write.mode("overwrite").parquet(f"{self.state}/{name}")
        stored = self.spark.read.schema(KEPT).parquet(f"{self.state}/{name}")
        decided(stored.where(f"unix_micros(day_end) <= {mark}"), self.limit).write.mode("overwrite").parquet(f"{self.out}/{name}")
        self.versions[key] = (f"{self.state}/{name}", mark, last)

    def _step(self, rows: DataFrame, number: int) -> None:
        """Rows of days that were open in the batch before still count; days are closed by what was seen before this batch."""
        opened, late, last = self._open((number, 0))
        fresh = dated(rows)
        newest = fresh.agg(F.max(F.unix_micros("day_end"))).first()[0]
        self._write((number, 0), kept(opened.unionByName(fresh.where(f"unix_micros(day_end) > {late}")), self.limit), max(late, self._until(last)), last if newest is None else max(last, newest))

    def _settle(self, mark: int | None = None) -> None:
        number, step = max(self.versions)
        opened, late, last = self._open((number + 1, 0))
        mark = max(late, mark or self._until(last))
        if mark > late:
            self._write((number, step + 1), opened, mark, last)

    def more(self) -> DataFrame:
        stream = self.source.writeStream.foreachBatch(self._step).option("checkpointLocation", self.progress).trigger(availableNow=True).start()
        stream.awaitTermination()
        self._settle()
        return self.results()

    def results(self) -> DataFrame:
        folders = [f"{self.out}/{number}-{step}" for number, step in self.versions if (number, step) != (-1, 0)]
        return self.spark.read.schema(OUT).parquet(*folders) if folders else self.spark.createDataFrame([], OUT)

    def closing(self) -> DataFrame:
        """Everything, after the watermark has been moved past all days; nothing more is taken in."""
        self.more()
        self._settle(END)
        return self.results()
