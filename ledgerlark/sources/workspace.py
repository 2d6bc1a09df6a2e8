"""Folders that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Spark's setting for dropping a query's shuffle files at its end; without it they stay as long as the driver holds the plan.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession, kind: str) -> str:
    """A new folder under spark.checkpoint.dir. Only a local master may go without that setting: machines of a cluster share no temporary folder."""
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not place:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        place = "file://" + tempfile.mkdtemp(prefix="ledgerlark-")
        spark.sparkContext.setCheckpointDir(place)
    return f"{place.rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def staged(df: DataFrame) -> DataFrame:
    """df by way of a written table: later overwrites of what it was read from cannot reach it. What was shuffled for it is dropped as soon as it is written."""
    spark, folder = df.sparkSession, shared_folder(df.sparkSession, "staged")
    before = spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.parquet(folder)
    finally:
        spark.conf.unset(CLEAN_UP) if before is None else spark.conf.set(CLEAN_UP, before)
    return spark.read.schema(df.schema).parquet(folder)
