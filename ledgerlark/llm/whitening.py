"""Embedding whitening: the Gramian matrix of exactly centred rows by Spark MLlib, its eigenvectors on the driver, and the rows projected in tasks.

Entries become whole numbers x = floor(`SCALE` * c) + `SHIFT`, so the sums S of each dimension and n * x - S are exact; a centred row
is (n * x - S) / n, rounded once. RowMatrix.computeGramianMatrix sums the products in a tree of tasks; divided by n it is the
covariance, a square of the dimension, which the driver decomposes. The projection is broadcast: a matrix of the dimension by the
number of components. What passes through the driver depends on the dimension alone.

Edge cases: rows whose vector is null or holds a null or a value that is no finite number are dropped, and so are rows whose length
is not that of most rows (of equally common lengths the greater; vectors of no entries are dropped always); null, equal and
repeated vec_ids stay rows of their own; components whose variance is zero in double precision are left out, so equal vectors and a
single row give no rows, as an empty table does; further columns are ignored; `deviation` is null where a long cannot hold it;
entries so large that a long cannot hold the number of rows times them raise an error.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlark.llm.common import saved, small_batches

SCALE, SHIFT = 1024, 100_000
SCHEMA = "vec_id long, deviation long, whitened array<double>"


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and x, the whole numbers of every vector of finite entries that has the most common length."""
    entries = F.transform("embedding", lambda c: c.cast("double"))
    finite = F.coalesce(F.forall(entries, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False))
    whole = F.when(finite, F.transform(entries, lambda c: F.floor(c * SCALE).cast("long") + SHIFT))
    rows = vectors.where(finite & (F.size("embedding") > 0))
    lengths = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    return rows.where(F.size("embedding") == (lengths[0].d if lengths else 0)).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("x"))


def gramian(rows: DataFrame, entries: Column) -> np.ndarray:
    """The sum over all rows of the outer product of an array of doubles with itself."""
    table = MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector(entries).alias("v")), "v")
    return RowMatrix(table).computeGramianMatrix().toArray()


def fitted(rows: DataFrame, most: int) -> tuple[int, list[int], np.ndarray, np.ndarray]:
    """(n, sums, projection, explained) of rows (x): a column of the projection and a share of the variance for each component."""
    sums = rows.select(F.posexplode("x").alias("k", "v")).groupBy("k").agg(F.sum("v").alias("s"), F.count(F.lit(1)).alias("n")).orderBy("k").collect()
    if not sums:
        return 0, [], np.zeros((0, 0)), np.zeros(0)
    n, total = sums[0].n, [r.s for r in sums]
    centred = F.zip_with("x", F.lit(total), lambda x, s: (x * F.lit(n).cast("long") - s).cast("double") / n)
    covariance = gramian(rows, centred) / n
    values, columns = np.linalg.eigh((covariance + covariance.T) / 2)
    values, columns = values[::-1], columns[:, ::-1]
    whole = values.sum()
    keep = np.flatnonzero(values > len(values) * np.finfo(float).eps * whole)[:most]
    return n, total, columns[:, keep] / np.sqrt(values[keep]), values[keep] / whole if len(keep) else np.zeros(0)


def squares(v: np.ndarray) -> np.ndarray:
    """The exact sum of squares of each row of whole numbers, None where a long cannot hold it."""
    if not v.size or np.abs(v).max() < 2 ** 31 // (1 + int(np.sqrt(v.shape[1]))):
        return (v * v).sum(axis=1).astype(object)
    exact = (v.astype(object) ** 2).sum(axis=1)
    return np.array([x if x < 2**63 else None for x in exact], object)


def whiten(vectors: DataFrame, components: int = 8) -> tuple[DataFrame, int, np.ndarray, float]:
    """(vec_id, deviation and the whitened vector of each usable row; their number; explained; identity_error)."""
    spark = vectors.sparkSession
    rows = small_batches(usable(vectors))
    n, sums, projection, explained = fitted(rows, components)
    if not len(explained):
        return spark.createDataFrame([], SCHEMA), n, explained, 0.0
    held = spark.sparkContext.broadcast((n, np.array(sums, np.int64), projection))

    def task(frames):
        n, sums, projection = held.value
        for frame in frames:
            if len(frame):
                v = n * np.stack(frame["x"].to_numpy()) - sums
                yield pd.DataFrame({"vec_id": frame["vec_id"].astype("Int64"), "deviation": pd.array(squares(v), "Int64"), "whitened": list((v / n) @ projection)})

    out = saved(rows.mapInPandas(task, SCHEMA))
    k = len(explained)
    mean = np.array(out.agg(*(F.avg(F.get("whitened", F.lit(j))).alias(f"m{j}") for j in range(k))).first())
    around = F.zip_with("whitened", F.lit(mean.tolist()), lambda w, m: w - m)
    error = float(np.abs(gramian(out, around) / n - np.eye(k)).max())
    return out, n, explained, error


def components(vectors: DataFrame, most: int = 8) -> DataFrame:
    """One row for each usable row and component."""
    out, n, explained, error = whiten(vectors, most)
    rows = out.select("vec_id", "deviation", F.posexplode("whitened").alias("k", "whitened"))
    share = F.get(F.lit(explained.tolist()).cast("array<double>"), F.col("k"))
    return rows.select("vec_id", (F.col("k") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", share.alias("explained"), F.lit(error).alias("identity_error"))
