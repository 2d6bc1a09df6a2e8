"""Sharding by longest-processing-time scheduling: groups of equal texts, largest first, each to the least-loaded shard.

The heap works on weights, not on groups: the driver holds one count for each distinct weight (all bytes of a group's copies,
exact), and there are few of these: different weights of a given total number no more than the root of twice that total. The
groups of a weight take the planned shards by their rank within the weight. Ranks and slots are counted in salted cells.

Edge cases: null and empty texts are one group of size 8 a row; rows with equal doc_id stay separate rows; a very long text is
a group like any other; fewer groups than shards leave shards empty; an empty table gives no rows; columns beyond doc_id and
text are ignored.
"""

from __future__ import annotations

import heapq
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlark.llm.common import salted_rank, saved

#: Numbers in a plan that may be broadcast (8 bytes each); a larger one is joined by shuffling.
BROADCAST_NUMBERS = 500_000
#: Equal weights that the heap deals one by one; more are dealt at once.
FEW = 100


def _dealt(loads: list[int], weight: int, count: int) -> list[int]:
    """How many of `count` equal weights each shard gets when each goes to the least-loaded shard (ties: lowest number).

    All but the last few land below a level that bisection finds; the heap deals the rest.
    """
    n = len(loads)
    low, high = 0, max(loads) + weight * (count // n + 1)
    taken = lambda level: sum(max(0, -(-(level - x) // weight)) for x in loads)  # noqa: E731  steps that start below level
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if taken(mid) <= count else (low, mid - 1)
    got = [max(0, -(-(low - x) // weight)) for x in loads]
    heap = [(x + g * weight, k) for k, (x, g) in enumerate(zip(loads, got, strict=True))]
    heapq.heapify(heap)
    for _ in range(count - sum(got)):
        x, k = heap[0]
        heapq.heapreplace(heap, (x + weight, k))
        got[k] += 1
    return got


def plan(histogram: list[tuple[int, int]], shards: int) -> list[tuple[int, list[int], list[int]]]:
    """(weight, shards that get groups, upper rank bound of each) for (weight, groups) pairs, largest weight first."""
    heap, out = [(0, k) for k in range(shards)], []
    for weight, count in sorted(histogram, reverse=True):
        got = [0] * shards
        if count <= FEW:
            for _ in range(count):
                load, k = heap[0]
                heapq.heapreplace(heap, (load + weight, k))
                got[k] += 1
        else:
            loads = [0] * shards
            for load, k in heap:
                loads[k] = load
            got = _dealt(loads, weight, count)
            heap = [(load + g * weight, k) for k, (load, g) in enumerate(zip(loads, got, strict=True))]
            heapq.heapify(heap)
        taken = [k for k, g in enumerate(got) if g]
        out.append((weight, taken, list(accumulate(got[k] for k in taken))))
    return out


def shard(docs: DataFrame, shards: int = 24) -> DataFrame:
    """doc_id, size (UTF-8 bytes plus 8), text_crc32, shard and slot (gapless in its shard) of every row."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = saved(docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text).cast("long") + 8).alias("size"),
                             F.crc32(text.cast("binary")).alias("text_crc32"), F.md5(text.cast("binary")).alias("key")))
    groups = saved(rows.groupBy("key").agg(F.sum("size").alias("weight")))
    counts = groups.groupBy("weight").agg(F.count(F.lit(1)).alias("n")).toArrow()
    weights, numbers = counts["weight"].to_pylist(), counts["n"].to_pylist()
    plans = plan(list(zip(weights, numbers, strict=True)), shards)
    columns = [pa.array([p[0] for p in plans], pa.int64()), pa.array([p[1] for p in plans], pa.list_(pa.int32())), pa.array([p[2] for p in plans], pa.list_(pa.int64()))]
    planned = spark.createDataFrame(pa.Table.from_arrays(columns, ["weight", "shards", "bounds"]))
    small = sum(len(p[1]) + 1 for p in plans) <= BROADCAST_NUMBERS
    placed = salted_rank(groups, "weight", ["key"], sum(numbers)).join(F.broadcast(planned) if small else planned, "weight")
    placed = placed.select("key", F.expr("shards[size(filter(bounds, b -> b <= rank))]").alias("shard"))
    rows = saved(rows.join(placed, "key").drop("key"))
    return salted_rank(rows, "shard", ["doc_id", "text_crc32"], sum(numbers), "slot")
