"""Best-fit packing planned on the histogram of lengths.

Best-fit decreasing runs over counts: the bins of one free space and one content are a bundle, so a step places as many
equal pieces as the bundle has bins. The plan has some thousands of rows at most (it depends on the 1024 lengths and not on
the documents); documents take planned slots by joining on their rank within their length.

Edge cases: a null or empty text is a document of its end id alone; rows with equal doc_id are separate documents; an empty
table gives no pieces; columns beyond doc_id and text are ignored.
"""

from __future__ import annotations

import bisect
import zlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlark.llm.common import salted_rank, saved, small_batches
from ledgerlark.llm.tokenise import encoded


def plan(histogram: dict[int, int], most: int) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, offset): rank r of that length goes to sequence first + r - first rank."""
    free: dict[int, deque] = {}  # free space -> bundles (first sequence, bins)
    spaces: list[int] = []
    out, sequences = [], 0

    def put(space: int, first: int, bins: int) -> None:
        if space and bins:
            if space not in free:
                free[space] = deque()
                bisect.insort(spaces, space)
            free[space].append((first, bins))

    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            k = bisect.bisect_left(spaces, length)
            if k == len(spaces):  # open bins, each filled with this length as far as it goes
                each = most // length
                bins, over = divmod(left, each)
                for part, n in ((each, bins), (over, 1 if over else 0)):
                    for j in range(part if n else 0):
                        out.append((length, rank, rank + n, sequences, j * length))
                        rank += n
                    put(most - part * length, sequences, n)
                    sequences += n
                left = 0
                continue
            space = spaces[k]
            first, bins = free[space].popleft()
            n = min(bins, left)
            out.append((length, rank, rank + n, first, most - space))
            if bins > n:
                free[space].appendleft((first + n, bins - n))
            if not free[space]:
                del free[space], spaces[k]
            put(space - length, first, n)
            rank, left = rank + n, left - n
    return out


def pieces(docs: DataFrame, tokenizer: str, end_id: int, most: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece; only a document of more than `most` ids is cut."""

    def task(batches):
        for batch in batches:
            for i, j, ids, bounds in encoded(batch.column(1), tokenizer):
                lengths = np.diff(bounds) + 1
                n = -(-lengths // most)
                row = np.repeat(np.arange(j - i), n)
                number = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                head = lengths - (n - 1) * most
                start = np.where(number == 0, 0, head[row] + (number - 1) * most)
                size = np.where(number == 0, head[row], most)
                all_ids = np.full(len(ids) + j - i, end_id, "<u4")
                spare = np.ones(len(all_ids), bool)
                spare[bounds[1:] + np.arange(j - i)] = False
                all_ids[spare] = ids
                raw = memoryview(all_ids.tobytes())
                at = ((bounds[:-1] + np.arange(j - i))[row] + start) * 4
                crc = [zlib.crc32(raw[a : a + b]) for a, b in zip(at.tolist(), (size * 4).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i).take(pa.array(row)), pa.array(number, pa.int32()), pa.array(start), pa.array(size), pa.array(crc, pa.int64())],
                    ["doc_id", "piece", "start", "length", "ids_crc32"])

    return small_batches(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(task, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, most: int = 1024) -> DataFrame:
    """The pieces of every document with their sequence_id and offset."""
    cut = saved(pieces(docs, tokenizer, end_id, most))
    histogram = {r.length: r["count"] for r in cut.groupBy("length").count().collect()}  # `most` rows at most
    slots = docs.sparkSession.createDataFrame(plan(histogram, most), "_l long, _from long, _to long, _seq long, offset long")
    ranked = salted_rank(cut, "length", ["doc_id", "piece", "ids_crc32"], sum(histogram.values()))
    fits = (ranked.length == slots._l) & (ranked["rank"] >= slots._from) & (ranked["rank"] < slots._to)
    return (ranked.join(F.broadcast(slots), fits)
            .select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("_seq") + F.col("rank") - F.col("_from")).alias("sequence_id"), "offset"))
