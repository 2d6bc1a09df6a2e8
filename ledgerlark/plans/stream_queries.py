"""Streaming jobs run to their end over the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlark import streaming as J
from ledgerlark.operators.relations import first_per
from ledgerlark.plans.catalog import stream_query
from ledgerlark.sources.workspace import shared_folder


@stream_query("ST6_tumbling_windows", sql="SELECT strftime(time_bucket(INTERVAL 6 HOUR, ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n, sum(CAST(value AS DECIMAL(18,4))) AS total FROM events GROUP BY 1, 2")
def tumbling(spark, sf_dir):
    return J.finished(J.tumbling(J.events(spark, sf_dir), "6 hours"), "complete")


@stream_query("ST6_sliding_windows", sql="""
SELECT strftime(time_bucket(INTERVAL 6 HOUR, ts) - to_hours(6 * k), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n, sum(CAST(value AS DECIMAL(18,4))) AS total FROM events, range(0, 4) r(k) GROUP BY 1, 2""")
def sliding(spark, sf_dir):
    return J.finished(J.tumbling(J.events(spark, sf_dir), "24 hours", "6 hours"), "complete")


@stream_query("ST_extension_sessions", sql="""
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 2 HOUR THEN 0 ELSE 1 END AS opens FROM events), s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def session_windows(spark, sf_dir):
    return J.finished(J.sessions(J.events(spark, sf_dir), "2 hours"), "complete")


@stream_query("ST1_ST2_deduplicated", sql="SELECT DISTINCT user_id, event_type, CAST(ts AS DATE) AS day FROM events")
def deduplicated(spark, sf_dir):
    rows = J.events(spark, sf_dir).withColumn("day", F.to_date("ts"))
    return J.finished(J.deduplicated(rows, ["user_id", "event_type", "day"], "45 days").select("user_id", "event_type", "day"))


@stream_query("ST2_keyed_upsert", sql="SELECT user_id, event_id, event_type, CAST(value AS DECIMAL(18,4)) AS value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def upserted(spark, sf_dir):
    path = shared_folder(spark, "latest")

    def merge(stored, rows):
        both = rows if stored is None else stored.unionByName(rows)
        return first_per(both, ["user_id"], [F.desc("ts"), F.desc("event_id")])

    J.upserting(J.events(spark, sf_dir).select("user_id", "event_id", "event_type", "ts", "value"), path, merge)
    newest = spark.read.parquet(path).agg(F.max("v")).first()[0]  # from the folders' names and one partial maximum a file
    return spark.read.parquet(f"{path}/v={newest}").select("user_id", "event_id", "event_type", F.col("value").cast("decimal(18,4)").alias("value"))


@stream_query("ST3_streaming_quota", sql="SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, event_id FROM events WHERE user_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY value DESC, event_id) <= 3")
def quota(spark, sf_dir):
    return J.QuotaRun(spark, J.events(spark, sf_dir), 3, "2 days").closing().select("user_id", "day", "event_id")


@stream_query("ST4_ledger_quota", sql="""
WITH e AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, event_id, value FROM events WHERE user_id IS NOT NULL), l AS (SELECT DISTINCT user_id, day, event_id FROM e WHERE event_id % 9 = 0),
n AS (SELECT user_id, day, count(*) AS taken FROM l GROUP BY 1, 2), r AS (SELECT e.*, row_number() OVER (PARTITION BY user_id, day ORDER BY value DESC, event_id) AS place FROM e ANTI JOIN l USING (user_id, day, event_id))
SELECT user_id, day, event_id, 'reserved' AS status FROM l UNION ALL SELECT r.user_id, r.day, r.event_id, 'queued' FROM r LEFT JOIN n USING (user_id, day) WHERE place <= 4 - coalesce(taken, 0)""")
def ledger_quota(spark, sf_dir):
    """The state starts from what deliveries have reserved already; these events pass again and the others share what is left."""
    stored = spark.read.parquet(f"{sf_dir}/events.parquet").where("user_id is not null and event_id % 9 = 0")
    ledger = stored.select("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_id").distinct()
    return J.QuotaRun(spark, J.events(spark, sf_dir), 4, "2 days", ledger).closing()
