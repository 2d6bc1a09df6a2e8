"""Token-ID / binary output: flat unsigned integer files with 64-bit document offsets, read back by memory map.

A folder holds, for each range partition of the ascending doc_id order, `part-N-A.ids` (little-endian token ids, 16 bits wide
where the vocabulary allows it, else 32), `part-N-A.off` (unsigned 64-bit offsets in ids, one more than documents) and
`part-N-A.doc` (64-bit doc_ids), A being the attempt that wrote it, and `index.json` with the width and each partition's base: the prefix sums of the partitions'
id and document counts, the only thing that passes through the driver (one row a partition).

Executor loss: a task writes under a name of its own attempt and tells it when its files are whole; the index, written last and at
once, names the attempts that count, and nothing reads what other attempts left. Rows with equal doc_id are ordered by a hash of their
text, so every attempt writes the same.

Edge cases: a null or empty text has the end id alone; rows with equal doc_id stay as separate documents; null doc_ids sort first and are kept (the index says how many a partition begins with); a very long text is one
document; an empty table gives no documents; columns beyond doc_id and text are ignored.
"""

from __future__ import annotations

import json
import os
import zlib
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.llm.common import small_batches
from ledgerlark.llm.tokenise import encoded


#: Bytes of text in a partition's files, where there are not more partitions anyway.
PART_BYTES = 1 << 28


def _place(uri: str) -> tuple[fs.FileSystem, str, bool]:
    parts = urlparse(uri)
    if parts.scheme in ("", "file"):
        return fs.LocalFileSystem(), parts.path, True
    return *fs.FileSystem.from_uri(uri), False


def _slices(uri: str, dtype: str):
    """slices(a, b) of a file's items: of its memory map where the store is a file system, else a read of that range."""
    files, path, local = _place(uri)
    if local:
        whole = np.memmap(path, dtype, mode="r") if os.path.getsize(path) else np.zeros(0, dtype)
        return lambda a, b: whole[a:b]
    f, size = files.open_input_file(path), np.dtype(dtype).itemsize
    return lambda a, b: np.frombuffer(f.read_at((b - a) * size, a * size), dtype)


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int, partitions: int | None = None) -> None:
    """Writes every document of `docs` (doc_id, text) to `folder`."""
    spark = docs.sparkSession
    width = 2 if _vocabulary(tokenizer) <= 1 << 16 else 4
    rows = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // PART_BYTES)
    ordered = rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))

    def task(batches):
        context = TaskContext.get()
        name = f"part-{context.partitionId():05d}-{context.taskAttemptId()}"
        files, base, _ = _place(folder)
        files.create_dir(base, recursive=True)
        kinds = ("ids", "off", "doc")
        out = {k: files.open_output_stream(f"{base}/{name}.{k}") for k in kinds}
        out["off"].write(np.zeros(1, "<u8").tobytes())
        total = count = nulls = 0
        for batch in batches:
            ids_of = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)
            nulls += batch.column(0).null_count
            for i, j, ids, bounds in encoded(batch.column(1), tokenizer):
                rows = j - i
                all_ids = np.full(len(ids) + rows, end_id, f"<u{width}")
                ends = bounds[1:] + np.arange(1, rows + 1)
                spare = np.ones(len(all_ids), bool)
                spare[ends - 1] = False
                all_ids[spare] = ids
                out["ids"].write(all_ids.tobytes())
                out["off"].write((total + ends).astype("<u8").tobytes())
                out["doc"].write(ids_of[i:j].astype("<i8").tobytes())
                total, count = total + len(all_ids), count + rows
        for k in kinds:
            out[k].close()
        yield pa.RecordBatch.from_pydict({"part": [context.partitionId()], "name": [name], "n_docs": [count], "n_ids": [total], "n_nulls": [nulls]})

    parts = sorted(ordered.mapInArrow(task, "part long, name string, n_docs long, n_ids long, n_nulls long").collect())
    index, ids, rows = [], 0, 0
    for p in parts:
        index.append({"name": p.name, "first_id": ids, "first_doc": rows, "ids": p.n_ids, "docs": p.n_docs, "nulls": p.n_nulls})
        ids, rows = ids + p.n_ids, rows + p.n_docs
    files, base, _ = _place(folder)
    files.create_dir(base, recursive=True)
    with files.open_output_stream(f"{base}/index.json") as f:
        f.write(json.dumps({"width": width, "end_id": end_id, "parts": index}).encode())


def _vocabulary(tokenizer: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer).get_vocab_size()


def read(spark: SparkSession, folder: str) -> DataFrame:
    """One row a document, from the files alone: doc_id, start, n_tokens, ids_crc32 (of the ids as 32-bit integers)."""
    files, base, _ = _place(folder)
    with files.open_input_file(f"{base}/index.json") as f:
        index = json.loads(f.readall())
    width, schema = index["width"], "doc_id long, start long, n_tokens long, ids_crc32 long"
    parts = [(p["name"], p["first_id"], p["docs"], p["nulls"]) for p in index["parts"] if p["docs"]]
    if not parts:
        return spark.createDataFrame([], schema)

    def task(batches):
        for batch in batches:
            for name, first, count, nulls in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                off, docs, ids = (_slices(f"{folder}/{name}.{k}", kind) for k, kind in (("off", "<u8"), ("doc", "<i8"), ("ids", f"<u{width}")))
                for i in range(0, count, 4096):
                    j = min(count, i + 4096)
                    at = off(i, j + 1).astype(np.int64)
                    raw = memoryview(np.asarray(ids(int(at[0]), int(at[-1]))).astype("<u4").tobytes())
                    cut = (at - at[0]) * 4
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.asarray(docs(i, j)), mask=np.arange(i, j) < nulls), pa.array(first + at[:-1]), pa.array(np.diff(at)),
                        pa.array([zlib.crc32(raw[a:b]) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)], pa.int64()),
                    ], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return spark.createDataFrame(parts, "name string, first long, docs long, nulls long").repartition(len(parts), "name").mapInArrow(task, schema)
