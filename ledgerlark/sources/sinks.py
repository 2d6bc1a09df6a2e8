"""Writes as joins: every sink takes the stored rows and the new ones and returns what is stored afterwards.

`upsert_partitions` applies one to a partitioned Parquet table and rewrites only the partitions that the new rows touch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlark.sources.workspace import staged


def upsert(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows replace stored rows of the same key. `new` has one row a key."""
    return stored.join(new.select(*keys), keys, "left_anti").unionByName(new)


def upsert_stamped(stored: DataFrame, new: DataFrame, keys: list[str], now: Column) -> DataFrame:
    """Upsert that keeps created_at where there is one and always sets updated_at."""
    old = stored.select(*keys, F.col("created_at").alias("_was"))
    fresh = new.join(old, keys, "left").withColumn("created_at", F.coalesce("_was", "created_at", now)).drop("_was").withColumn("updated_at", now)
    return upsert(stored.withColumn("updated_at", F.lit(None).cast(fresh.schema["updated_at"].dataType)), fresh, keys)


def replace_matching(stored: DataFrame, new: DataFrame, *key_sets: list[str]) -> DataFrame:
    """Stored rows that share any of the key sets with a new row go, then the new rows come in."""
    kept = stored
    for keys in key_sets:
        kept = kept.join(new.select(*keys).distinct(), keys, "left_anti")
    return kept.unionByName(new)


def replace_derived(stored: DataFrame, new: DataFrame, key: Callable[[Column], Column], column: str) -> DataFrame:
    """Replacement by a key worked out from a column (a filing's prefix, an accession)."""
    gone = new.select(key(F.col(column)).alias("_k")).distinct()
    return stored.withColumn("_k", key(F.col(column))).join(gone, "_k", "left_anti").drop("_k").unionByName(new)


def register_missing(dimension: DataFrame, facts: DataFrame, key: str, **defaults: Column) -> DataFrame:
    """The dimension with a row for every key of the facts."""
    absent = facts.where(F.col(key).isNotNull()).select(key).distinct().join(dimension.select(key), key, "left_anti")
    return dimension.unionByName(absent.withColumns(defaults), allowMissingColumns=True)


def upsert_keeping(stored: DataFrame, new: DataFrame, key: str, column: str, keep: Callable[[Column], Column]) -> DataFrame:
    """Upsert in which a stored value that `keep` accepts stays."""
    old = stored.select(key, F.col(column).alias("_old"))
    fresh = new.join(old, key, "left").withColumn(column, F.when(F.col("_old").isNotNull() & keep(F.col("_old")), F.col("_old")).otherwise(F.col(column))).drop("_old")
    return upsert(stored, fresh, [key])


def changes(stored: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key and action (insert, update or skip) by a hash of the columns' content."""
    def digest(rows: DataFrame, name: str) -> DataFrame:
        return rows.select(key, F.sha2(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)), 256).alias(name))
    both = digest(new, "_new").join(digest(stored, "_old"), key, "left")
    return both.select(key, F.when(F.col("_old").isNull(), "insert").when(F.col("_old") != F.col("_new"), "update").otherwise("skip").alias("action"))


def keep_reviewed(candidates: DataFrame, stored: DataFrame, key: str, columns: list[str], pending: str = "pending_review") -> DataFrame:
    """Candidates in which reviewed rows keep their status and the given columns."""
    old = stored.where(F.col("status") != pending).select(key, *(F.col(c).alias(f"_{c}") for c in ["status", *columns]))
    joined = candidates.join(old, key, "left")
    return joined.withColumns({c: F.when(F.col("_status").isNotNull(), F.col(f"_{c}")).otherwise(F.col(c)) for c in ["status", *columns]}).select(*candidates.columns)


def prune(stored: DataFrame, valid: DataFrame, key: str, stale: Column) -> DataFrame:
    """Drops stale rows whose key is no longer valid."""
    known = valid.select(key).distinct().withColumn("_ok", F.lit(True))
    return stored.join(known, key, "left").where(F.col("_ok").isNotNull() | ~F.coalesce(stale, F.lit(False))).drop("_ok")


def backfill(rows: DataFrame, *sources: tuple[DataFrame, list[str]], column: str) -> DataFrame:
    """Fills an empty column from the first source that has it; a source is (rows, keys) with one row a key."""
    out, tried = rows, [F.nullif(F.trim(F.col(column)), F.lit(""))]
    for k, (source, keys) in enumerate(sources):
        out = out.join(source.select(*keys, F.col(column).alias(f"_{k}")), keys, "left")
        tried.append(F.col(f"_{k}"))
    return out.withColumn(column, F.coalesce(*tried)).select(*rows.columns)


def delivered(pending: DataFrame, results: DataFrame, key: str, now: Column, most: int = 3) -> DataFrame:
    """Deliveries after a round: sent, failed for good after `most` attempts, else pending again."""
    joined = pending.join(results.select(key, "ok"), key, "left")
    tries = F.col("attempts") + F.when(F.col("ok").isNotNull(), 1).otherwise(0)
    status = F.when(F.col("ok"), "sent").when(F.col("ok").isNull(), F.col("status")).when(tries >= most, "failed").otherwise("pending")
    return joined.withColumns({"attempts": tries, "status": status, "sent_at": F.when(F.col("ok"), now)}).drop("ok")


def corrected_once(rows: DataFrame, suspicious: Column, column: str, factor: int) -> DataFrame:
    """Multiplies a column if every row looks like the old unit, in one pass without collecting: the guard is a joined aggregate."""
    guard = rows.agg((F.count("*") == F.count_if(suspicious)).alias("_all"))
    return rows.crossJoin(F.broadcast(guard)).withColumn(column, F.when(F.col("_all"), F.col(column) * factor).otherwise(F.col(column))).drop("_all")  # one row


def upsert_partitions(new: DataFrame, path: str, keys: list[str], partition: str) -> None:
    """Upserts into a Parquet table partitioned by `partition`; untouched partitions are neither read nor written.

    The merged rows are staged first, so a failed write loses nothing and a second run gives the same table.
    """
    spark = new.sparkSession
    touched = [r[0] for r in new.select(partition).distinct().collect()]  # partition values alone
    stored = spark.read.parquet(path).where(F.col(partition).isin(touched))
    merged = staged(upsert(stored.select(*new.columns), new, keys))
    merged.repartition(partition, F.pmod(F.xxhash64(*keys), F.lit(16))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
