"""Shared helpers: work folders, reliable checkpoints, row salts, and numpy views of Arrow text.

The text helpers work on the UTF-8 buffers that Arrow hands to a task, a block of rows at a time, so that no per-word Python
objects are made. A block holds about `BLOCK` bytes; a longer row is a block of its own, whole.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK, BATCH_ROWS, BATCH_BYTES = 1 << 20, 2000, 1 << 22


def work_dir(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir. Only a local master may go without it: machines of a cluster share no temporary folder."""
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not place:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        place = "file://" + tempfile.mkdtemp(prefix="ledgerlark-")
        spark.sparkContext.setCheckpointDir(place)
    return place


def small_batches(df: DataFrame) -> DataFrame:
    """df, whose session from now on passes batches of at most BATCH_ROWS rows and about BATCH_BYTES bytes to Python and back.

    Texts are long: the default of 10,000 rows would hold whole tens of megabytes several times over in each task.
    """
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        now = df.sparkSession.conf.get(key, None)
        held = int(now.removesuffix("b")) if now else 0
        if held <= 0 or held > most:
            df.sparkSession.conf.set(key, most)
    return df


def saved(df: DataFrame) -> DataFrame:
    """df by way of a reliable checkpoint, which survives lost executors."""
    place = work_dir(df.sparkSession)
    if not df.sparkSession.sparkContext.getCheckpointDir():
        df.sparkSession.sparkContext.setCheckpointDir(place)
    return df.checkpoint(eager=True)


def new_folder(spark: SparkSession, kind: str) -> str:
    return f"{work_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def salted_rank(df: DataFrame, group: str, order: list[str], rows: int, out: str = "rank") -> DataFrame:
    """Adds a gapless 0-based rank within `group` without ever bringing one group into one task.

    Rows are dealt to (group, salt) cells of about 100,000 rows; a rank is the row number inside the cell plus the rows of
    the group's earlier cells. Needs a deterministic `df` (a checkpoint), since it is read twice.
    """
    salts = max(16, rows // 100_000)
    cells = df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)))
    sums = cells.groupBy(group, "_salt").agg(F.count(F.lit(1)).alias("_n")).select(
        F.col(group).alias("_g"), F.col("_salt").alias("_s"),
        F.expr(f"sum(_n) over (partition by {group} order by _salt rows between unbounded preceding and current row) - _n").alias("_before"))
    by = ", ".join(order)
    ranked = cells.withColumn("_in", F.expr(f"row_number() over (partition by {group}, _salt order by {by})") - 1)
    return (ranked.join(sums, ranked[group].eqNullSafe(sums["_g"]) & (ranked["_salt"] == sums["_s"]))
            .withColumn(out, F.col("_before") + F.col("_in")).drop("_g", "_s", "_before", "_in", "_salt"))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- numpy views of text -------------------------------------------------------------------------------------------

def _set(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for a, b in ranges:
        out[a : b + 1] = True
    return out


#: The six ASCII white-space bytes.
SPACE = _set((0x20, 0x20), (0x09, 0x0D))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Spans of more bytes are hashed one by one.
LONG_SPAN = 512
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def text_blocks(column: pa.Array, most: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) for blocks of rows of a string column; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    n = len(column)
    if n == 0:
        return
    off = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield i, j, raw[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def spans(buf: np.ndarray, off: np.ndarray, gap_bytes: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of other bytes than gap_bytes, and the index of each row's first run."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    gap = gap_bytes[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[off] = True
    cut = gap[:-1] | edge[1:-1]
    first = ~gap
    first[1:] &= cut
    last = ~gap
    last[:-1] &= gap[1:] | edge[1:-1]
    s = np.flatnonzero(first)
    return s, np.flatnonzero(last) + 1, np.searchsorted(s, off)


def padded(buf: np.ndarray) -> np.ndarray:
    """buf and eight zeros, which span_hash reads past the end."""
    return np.concatenate([buf, np.zeros(8, np.uint8)])


def span_hash(buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans [s, e) of a padded buffer, the same wherever a span stands.

    Eight bytes at a time are mixed into what the bytes before gave, so no arithmetic relation between bytes cancels out.
    """
    eights = np.ndarray((len(buf) - 7,), "<u8", buffer=buf.data, strides=(1,))
    n = e - s
    out = mixed(n.astype(np.uint64) * _ODD)
    long = n > LONG_SPAN
    at = np.flatnonzero((n > 0) & ~long)
    step = 0
    while len(at):
        left = n[at] - step
        out[at] = mixed(out[at] * _ODD + (eights[s[at] + step] & _MASKS[np.minimum(left, 8)]))
        at, step = at[left > 8], step + 8
    for i in np.flatnonzero(long).tolist():
        out[i] = xxhash.xxh3_64_intdigest(buf[s[i] : e[i]])
    return out


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices start, start + 1, ... of every range, one range after the other."""
    total = int(lengths.sum())
    shift = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    return shift + np.arange(total)
