"""Quality rules: cross-document line frequency per host, and the base counts of one text.

Lines are normalised (ASCII lower case, digits as 0, white space as one space) and hashed; a line is boilerplate, and its words are
removed, if more than `SHARE` of a host's documents hold it, beyond what chance makes of that share among so many documents (a score
test at `Z`), and more than `FLOOR` of them do; a document that loses more than `LOSS` of its words is depleted and rejected.
The limit is 9 of 50 documents, 116 of 1,000, 1,050 of 10,000, and nears the share itself on larger hosts.

Counting goes by (host, line), so a line that every document has is summed from partial counts. Few lines of a host can be
above a share of its documents, so what joins the documents' lines is small; it has one row a line, so a hot line is split
like any skewed join.

Edge cases: a null or empty text has no words and fails the base rule; a null host is a host of its own; repeated rows give
equal rows and count as one document; a very long text counts whole; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlark.llm.common import LOWER, SPACE, mixed, padded, saved, small_batches, span_hash, spans, text_blocks

FLOOR, SHARE, Z, LOSS = 2, 0.1, 1.645, 0.5
_NORMAL = LOWER.copy()
_NORMAL[48:58] = 48
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
SCHEMA = ("doc_id long, host string, th long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "line array<long>, words array<int>")


def _sums(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[bounds])


def _repeats(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Marks the words that stand in a 3-word window found twice or more in their document."""
    out = np.zeros(len(h), bool)
    if len(h) < 3:
        return out
    inside = doc[2:] == doc[:-2]
    w = mixed(mixed(mixed(h[:-2]) + h[1:-1]) + h[2:]) + mixed(doc[:-2].astype(np.uint64))
    _, back, n = np.unique(w[inside], return_inverse=True, return_counts=True)
    at = np.flatnonzero(inside)[n[back] > 1]
    for k in range(3):
        out[at + k] = True
    return out


def counted(batches):
    for batch in batches:
        texts = batch.column(3)
        parts = []
        for i, j, buf, off in text_blocks(texts):
            rows = j - i
            s, e, first = spans(buf, off)
            doc = np.repeat(np.arange(rows), np.diff(first))
            plain = padded(buf)
            h = span_hash(plain, s, e)
            lead = (buf & 0xC0) != 0x80
            # lines: runs between line feeds that hold a word; a row's end closes a line too
            breaks = np.unique(np.concatenate([np.flatnonzero(buf == 10) + 1, off]))
            ls, le = breaks[:-1], breaks[1:]
            le = le - (buf[np.maximum(le - 1, 0)] == 10) if len(le) else le
            a, b = np.searchsorted(s, ls), np.searchsorted(s, le)
            has = b > a
            ls, le, a, b = ls[has], le[has], a[has], b[has]
            ldoc = np.searchsorted(off, ls, "right") - 1
            raw = span_hash(plain, ls, le) + mixed(ldoc.astype(np.uint64))
            unique = np.zeros(len(raw), bool)
            unique[np.unique(raw, return_index=True)[1]] = True
            # normalised lines stand in a buffer of their own: one space for each run of white space
            gap = SPACE[buf]
            keep = ~gap
            keep[1:] |= ~gap[:-1]
            place = np.concatenate([[0], np.cumsum(keep)])
            normal = np.where(gap, np.uint8(32), _NORMAL[buf])[keep]
            line = span_hash(padded(normal), place[s[a]], place[e[b - 1]]).view(np.int64) if len(a) else np.zeros(0, np.int64)
            lrow = np.searchsorted(ldoc, np.arange(rows + 1)).astype(np.int32)
            parts.append((
                np.diff(first), _sums(lead & ~SPACE[buf], off), _sums(_SYMBOL[buf], off), _sums(~unique, lrow), _sums(_repeats(h, doc), first),
                pa.ListArray.from_arrays(lrow, pa.array(line)), pa.ListArray.from_arrays(lrow, pa.array((b - a).astype(np.int32)))))
        if parts:
            stats = [pa.array(np.concatenate(c).astype(np.int64)) for c in list(zip(*parts, strict=True))[:5]]
            lists = [pa.concat_arrays(c) for c in list(zip(*parts, strict=True))[5:]]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *stats, *lists], [x.split()[0] for x in SCHEMA.split(", ")])


def rules(docs: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, the base counts, base_failed, n_removed (words in boilerplate lines) and kept of every row."""
    rows = saved(small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(host).cast("string").alias("host"), F.xxhash64("text").alias("th"), "text")
                 .mapInArrow(counted, SCHEMA))
    documents = rows.dropDuplicates(["doc_id", "host", "th"])
    limits = rows.groupBy("host").agg(F.count_distinct(F.struct("doc_id", "th")).alias("_n")).select(F.col("host").alias("_h"), F.greatest(F.lit(FLOOR), F.floor(F.col("_n") * SHARE + F.sqrt(F.col("_n") * (SHARE * (1 - SHARE))) * Z)).alias("most"))
    lines = documents.select("host", F.explode(F.array_distinct("line")).alias("line")).groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > FLOOR)
    common_lines = lines.join(limits, lines["host"].eqNullSafe(limits["_h"])).where("n > most").drop("_h")
    each = documents.select("doc_id", "host", "th", F.explode(F.arrays_zip("line", "words")).alias("l"))
    each = each.select("doc_id", "host", "th", F.col("l.line").alias("line"), F.col("l.words").alias("n_line"))
    bad = common_lines.select(F.col("host").alias("_h"), F.col("line").alias("_l"))
    lost = (each.join(bad, each["host"].eqNullSafe(bad["_h"]) & (each["line"] == bad["_l"]))
            .groupBy(F.col("doc_id").alias("_d"), F.col("host").alias("_h"), F.col("th").alias("_t")).agg(F.sum("n_line").alias("lost")))
    out = rows.join(lost, rows["doc_id"].eqNullSafe(lost["_d"]) & rows["host"].eqNullSafe(lost["_h"]) & (rows["th"] == lost["_t"]), "left")
    removed = F.coalesce("lost", F.lit(0).cast("long"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
                      (~failed & (removed <= F.lit(LOSS) * F.col("n_words"))).alias("kept"), removed.alias("n_removed"))
