"""Periodic runs of words: aligned blocks of power-of-two lengths searched by an Aho-Corasick automaton over word numbers.

A run is a longest stretch of words whose smallest period q has words q apart identical, of at least max(`LEAST`, `TIMES` * q)
words. At scale B (1, 2, 4, ...) a run of period B <= q < 2 * B holds a block that begins at a multiple of B and stands again q
words later. So the blocks of scale B become keys of one automaton, it runs over the words, and an occurrence at p is a seed if
the one aligned block in (p - 2 * B, p - B] has the same content: every position has one seed a scale at most. A seed is extended
word by word to both sides; a stretch found under several periods keeps the smallest.

Every word of a run but its first q stands at most q words after its last occurrence. Stretches of words that all recur so soon
are found with numpy for each scale; only they can hold runs of that scale, and only they go through the automaton.

Edge cases: a null, empty or blank text has no words and no runs; a very long text is worked on whole, alone in its block, with
some 100 bytes a word where it repeats itself; repeated rows and rows with equal or null doc_id give a row each; an empty table
gives no rows; further columns are ignored.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlark.llm.common import padded, small_batches, span_hash, spans, text_blocks

LEAST, TIMES = 6, 4
SCHEMA = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _stretch(x: np.ndarray, at: int, q: int) -> tuple[int, int]:
    """The longest stretch around x[at] == x[at + q] in which words q apart are identical."""
    end, step = at, 64
    while end + q < len(x):
        k = min(step, len(x) - q - end)
        unlike = np.flatnonzero(x[end : end + k] != x[end + q : end + q + k])
        if len(unlike):
            end += int(unlike[0])
            break
        end, step = end + k, step * 4
    start, step = at, 64
    while start:
        k = min(step, start)
        unlike = np.flatnonzero(x[start - k : start] != x[start - k + q : start + q])
        if len(unlike):
            start += int(unlike[-1]) + 1 - k
            break
        start, step = start - k, step * 4
    return start, end + q


def seeds(x: np.ndarray, size: int):
    """(a, q): the aligned block of `size` words at a stands again at a + q, size <= q < 2 * size; ascending by a + q."""
    words = tuple(x.tolist())
    names: dict[tuple, int] = {}
    machine = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    blocks = []
    for a in range(0, len(words) - size + 1, size):
        key = words[a : a + size]
        if key not in names:
            names[key] = len(names)
            machine.add_word(key, names[key])
        blocks.append(names[key])
    machine.make_automaton()
    for last, name in machine.iter(words):
        p = last - size + 1
        a = (p - size) // size * size
        if a >= 0 and blocks[a // size] == name:
            yield a, p - a


def search(x: np.ndarray, size: int, found: dict[tuple[int, int], int]) -> None:
    """Adds the runs of x with periods from size to 2 * size - 1 to found: (start, end) -> smallest period."""
    held: dict[int, tuple[int, int]] = {}
    for a, q in seeds(x, size):
        start, end = held.get(q, (0, 0))
        if start <= a and a + size + q <= end:
            continue
        start, end = held[q] = _stretch(x, a, q)
        if end - start >= max(LEAST, TIMES * q):
            found[start, end] = min(q, found.get((start, end), q))


def runs_of_block(h: np.ndarray, first: np.ndarray) -> dict[int, list[tuple[int, int, int]]]:
    """{row: [(start, length, period)] by start and period} for the rows of a block that have runs. h: word hashes, first: each row's first word."""
    n = len(h)
    if n < LEAST:
        return {}
    order = np.argsort(h, kind="stable")
    fresh = np.ones(n, bool)
    fresh[1:] = h[order[1:]] != h[order[:-1]]
    x = np.empty(n, np.int64)
    x[order] = np.cumsum(fresh) - 1
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    again = ~fresh[1:] & (doc[order[1:]] == doc[order[:-1]])
    apart = np.full(n, n + 1)
    apart[order[1:][again]] = (order[1:] - order[:-1])[again]
    found: dict[int, dict[tuple[int, int], int]] = {}
    size, longest = 1, int(np.diff(first).max())
    while TIMES * size <= longest:
        soon = np.zeros(n + 2, np.int8)
        soon[1:-1] = apart < 2 * size
        edge = np.flatnonzero(np.diff(soon))
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if b - a < max(LEAST - size, (TIMES - 1) * size):
                continue
            row = int(doc[a])
            base = int(first[row])
            low = max(base, a - 2 * size + 1)
            part: dict[tuple[int, int], int] = {}
            search(x[low:b], size, part)
            own = found.setdefault(row, {})
            for (s, e), q in part.items():
                at = (s + low - base, e + low - base)
                own[at] = min(q, own.get(at, q))
        size *= 2
    return {row: [(s, e - s, q) for s, e, q in sorted((s, e, q) for (s, e), q in own.items())] for row, own in found.items() if own}


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Marks the words that no run contains after its first period."""
    change = np.zeros(n + 1, np.int64)
    for start, length, q in runs:
        change[start + q] += 1
        change[start + length] -= 1
    return np.cumsum(change[:-1]) == 0


def _task(batches):
    for batch in batches:
        for i, j, buf, off in text_blocks(batch.column(1)):
            s, e, first = spans(buf, off)
            runs = runs_of_block(span_hash(padded(buf), s, e), first)
            data = buf.tobytes()
            texts = []
            for k, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
                if k in runs:
                    at = a + np.flatnonzero(kept_words(b - a, runs[k]))
                    texts.append(b" ".join([data[p:q] for p, q in zip(s[at].tolist(), e[at].tolist(), strict=True)]).decode())
                else:
                    texts.append(b" ".join(data[off[k] : off[k + 1]].split()).decode())
            listed = [[{"start": p, "length": n, "period": q} for p, n, q in runs.get(k, ())] for k in range(j - i)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(np.diff(first)), pa.array(listed, pa.list_(_RUN)), pa.array(texts)], ["doc_id", "n_words", "runs", "collapsed"])


def find(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, runs (by start, then period) and collapsed (the words kept, joined by one space) of every row of docs (doc_id, text)."""
    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_task, SCHEMA)


def looped(docs: DataFrame) -> DataFrame:
    """doc_id and text, where the tenth of the documents with crc32(doc_id) % 10 = 0 repeats a stretch of its own words to its end.

    With g = floor(crc32 / 10) and n words, the word at i >= a = g % n becomes the word at a + (i - a) % p, p = 1 + floor((n - a) / (3 + g % 8)).
    """
    gaps = r"[\x20\x09-\x0D]+"
    words: Column = F.array_remove(F.split("text", gaps), "")
    chosen = F.coalesce((F.crc32(F.col("doc_id").cast("string")) % 10 == 0) & F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), chosen.alias("_on"))
    rows = rows.withColumn("_w", F.when(F.col("_on"), words)).withColumn("_g", F.expr("crc32(cast(doc_id as string)) div 10"))
    rows = rows.withColumn("_a", F.expr("cast(_g % size(_w) as int)")).withColumn("_p", F.expr("cast(1 + (size(_w) - _a) div (3 + _g % 8) as int)"))
    loop = F.expr("array_join(concat(slice(_w, 1, _a), transform(sequence(0, size(_w) - _a - 1), i -> _w[_a + i % _p])), ' ')")
    return rows.select("doc_id", F.when(F.col("_on"), loop).otherwise(F.col("text")).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """One row of numbers and hashes for each row of `find`."""
    best = F.expr("array_max(transform(runs, r -> struct(r.length as length, -r.start as s, -r.period as p)))")
    listed = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return out.select("doc_id", "n_runs", (-F.col("b.s")).alias("start"), F.col("b.length").alias("length"), (-F.col("b.p")).alias("period"),
                      F.expr("1000 * b.length div -b.p").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
