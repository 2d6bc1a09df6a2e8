"""Toxicity by cumulative-link ordinal regression on sparse text features.

P(grade > j) = sigmoid(w.x - t_j) with one weight vector for all ordered thresholds t_0 < t_1 < t_2; the expected severity is
the sum of these probabilities, from 0 to 3, and a document whose P(grade > 0) is above one half is toxic. Features are hashed
whole words and word beginnings of 3 to 7 bytes, as log(1 + count), and each again where a text has it twice or more.

The labels say toxic or not; the grade of a toxic training document is 1 to 3 by the thirds of its number of marked words, a
word being marked where one of its features is. That makes the upper thresholds a matter of how much is marked; labels that are graded
themselves would do better. Features are screened first: those in `LEAST` toxic training documents or more, at least `ODDS`
times as frequent among these, whose likelihood ratio Benjamini-Hochberg accepts at `RATE`, so few labels are made use of too.

The model is fitted on a bounded sample of labelled rows, `SAMPLE` toxic and twice as many others (those with the smallest
hash of doc_id, one text a doc_id); all else runs over all rows.

Edge cases: a null or empty text has severity 0 of its features alone, so it is never toxic by its words; without labels of
both kinds everything scores 0; a document labelled twice counts by each label; repeated rows give equal rows; a very
long text is scored whole; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlark.llm.common import LOWER, padded, saved, small_batches, span_hash, spans, text_blocks

BITS, SAMPLE, LEAST, ODDS, RATE, BEGIN = 20, 3000, 2, 10.0, 0.05, (3, 4, 5, 6, 7)
NONE = 1 << BITS  # also the distance from a feature to its second form, twice or more
_GAP = np.ones(256, bool)
_GAP[48:58] = _GAP[65:91] = _GAP[97:123] = _GAP[128:] = False


def features(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words x features) hashed to 2**BITS, NONE for none, and each row's first word."""
    buf = LOWER[buf]
    s, e, first = spans(buf, off, _GAP)
    buf = padded(buf)
    salt = [np.uint64(k * 0x9E3779B97F4A7C15 % 2**64) for k in range(1, len(BEGIN) + 2)]
    out = np.full((len(s), len(BEGIN) + 1), NONE, np.int64)
    out[:, 0] = (span_hash(buf, s, e) ^ salt[0]) >> np.uint64(64 - BITS)
    for k, size in enumerate(BEGIN, 1):
        long = e - s > size
        out[long, k] = (span_hash(buf, s[long], s[long] + size) ^ salt[k]) >> np.uint64(64 - BITS)
    return out, first


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _counts(f: np.ndarray, first: np.ndarray, marked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, count) of the marked features."""
    w, k = np.nonzero(marked[f])
    pair, n = np.unique((np.searchsorted(first, w, "right") - 1) * NONE + f[w, k], return_counts=True)
    return pair // NONE, pair % NONE, n


class Model:
    """Weights by feature, those of the second form after the others, and thresholds."""

    def __init__(self, index: np.ndarray, weight: np.ndarray, cuts: np.ndarray):
        self.index, self.weight, self.cuts = index, weight, cuts
        self.table = None

    def scores(self, f: np.ndarray, first: np.ndarray) -> np.ndarray:
        """P(grade > j) by row and j."""
        if self.table is None:  # made where it is used: the model itself stays small
            self.table, self.marked = np.zeros(2 * NONE), np.zeros(NONE + 1, bool)
            self.table[self.index] = self.weight
            self.marked[self.index % NONE] = True
        z = np.zeros(len(first) - 1)
        row, feature, n = _counts(f, first, self.marked)
        np.add.at(z, row, np.log1p(n) * (self.table[feature] + np.where(n > 1, self.table[feature + NONE], 0)))
        return _sigmoid(z[:, None] - self.cuts)


NOTHING = Model(np.zeros(0, np.int64), np.zeros(0), np.full(3, 40.0))


def _level(ratio: np.ndarray) -> float:
    """The least likelihood ratio that Benjamini-Hochberg accepts at RATE: few labels give a low level, many features a high one."""
    ordered = np.sort(ratio)[::-1]
    p = np.array([math.erfc(math.sqrt(max(x, 0) / 2)) for x in ordered])
    ok = np.flatnonzero(p <= RATE * np.arange(1, len(p) + 1) / max(1, len(p)))
    return float(ordered[ok[-1]]) if len(ok) else math.inf


def fit(blocks: list[tuple[np.ndarray, np.ndarray]], toxic: np.ndarray, steps: int = 400) -> Model:
    """The model for documents given as blocks of (bytes, offsets).

    Features are worked out twice, first to screen them and then to keep the marked ones, so that memory holds little but texts.
    """
    n1, n0, size = int(toxic.sum()), int((~toxic).sum()), len(toxic)
    if not n1 or not n0:
        return NOTHING

    def documents():
        r = 0
        for buf, off in blocks:
            f, first = features(buf, off)
            for k in range(len(off) - 1):
                yield r, f[first[k] : first[k + 1]]
                r += 1

    df = np.zeros((2, 2 * NONE), np.int32)
    for r, f in documents():
        got, n = np.unique(f[f < NONE], return_counts=True)
        df[int(toxic[r]), got] += 1
        df[int(toxic[r]), got[n > 1] + NONE] += 1
    index = np.flatnonzero(df[1] >= LEAST)
    d0, d1 = df[:, index].astype(float)
    p1, p0, both = (d1 + 0.05) / (n1 + 0.1), (d0 + 0.05) / (n0 + 0.1), (d1 + d0 + 0.1) / (n1 + n0 + 0.2)
    ratio = 2 * (d1 * np.log(p1 / both) + d0 * np.log(p0 / both))
    index = index[(p1 > ODDS * p0) & (ratio >= _level(ratio))]
    if not len(index):
        return NOTHING
    marked = np.zeros(NONE + 1, bool)
    marked[index % NONE] = True
    place = np.full(2 * NONE, -1, np.int32)
    place[index] = np.arange(len(index))
    words, rows, columns, values = np.zeros(size), [], [], []
    for r, f in documents():
        words[r] = marked[f].any(axis=1).sum()
        got, n = np.unique(f[marked[f]], return_counts=True)
        got, n = np.concatenate([got, got[n > 1] + NONE]), np.concatenate([n, n[n > 1]])
        at = place[got]
        columns.append(at[at >= 0])
        values.append(np.log1p(n[at >= 0]))
        rows.append(np.full(len(columns[-1]), r))
    grade = np.where(toxic, 1 + np.searchsorted(np.quantile(words[toxic], [1 / 3, 2 / 3]), words, "right"), 0)
    rows, columns, values = map(np.concatenate, (rows, columns, values))
    w, cut = np.zeros(len(index)), np.array([2.0, 0.0, 0.0])  # cuts: first, then log steps
    m, v = np.zeros(len(w) + 3), np.zeros(len(w) + 3)
    for t in range(1, steps + 1):
        cuts = np.cumsum([cut[0], *np.exp(cut[1:])])
        p = _sigmoid(np.bincount(rows, values * w[columns], size)[:, None] - cuts)
        # P(grade = g) is the difference of neighbours; gradient of its log by z and by the cuts
        full = np.concatenate([np.ones((size, 1)), p, np.zeros((size, 1))], axis=1)
        slope = full * (1 - full)
        r = np.arange(size)
        like = np.maximum(full[r, grade] - full[r, grade + 1], 1e-9)
        up, down = slope[r, grade] / like, slope[r, grade + 1] / like
        dz = (up - down) / size
        by_cut = np.zeros((size, 5))
        by_cut[r, grade] -= up / size
        by_cut[r, grade + 1] += down / size
        dc = by_cut.sum(axis=0)[1:4]
        step = np.exp(cut[1:])
        g = np.concatenate([np.bincount(columns, values * dz[rows], len(index)) - 1e-4 * w, [dc.sum(), dc[1:].sum() * step[0], dc[2] * step[1]]])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, cut = w + move[:-3], cut + move[-3:]
    return Model(index, w, np.cumsum([cut[0], *np.exp(cut[1:])]))


def _fitted(batches):
    blocks, toxic = [], []
    for batch in batches:
        toxic += batch.column(0).to_pylist()
        blocks += [(buf.copy(), off) for _, _, buf, off in text_blocks(batch.column(1))]
    model = fit(blocks, np.array(toxic, bool))
    yield pa.RecordBatch.from_pydict({"index": [model.index.astype("<i8").tobytes()], "weight": [model.weight.astype("<f8").tobytes()], "cuts": [model.cuts.astype("<f8").tobytes()]})


def trained(docs: DataFrame, labels: DataFrame) -> Model:
    """The model of the bounded sample. One task fits it; the driver gets weights and thresholds alone."""
    known = labels.where("doc_id is not null and toxic is not null").select("doc_id", (F.col("toxic") == 1).alias("toxic"))
    part = lambda toxic, n: known.where(F.col("toxic") == toxic).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    chosen = saved(part(True, SAMPLE).unionByName(part(False, 2 * SAMPLE)))
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    texts = texts.repartition(1).sortWithinPartitions("doc_id", "toxic")
    got = texts.select("toxic", "text").mapInArrow(_fitted, "index binary, weight binary, cuts binary").collect()
    return Model(*(np.frombuffer(got[0][c], kind) for c, kind in (("index", "<i8"), ("weight", "<f8"), ("cuts", "<f8")))) if got else NOTHING


def _graded(model: Model):
    def task(batches):
        for batch in batches:
            parts = [model.scores(*features(buf, off)) for _, _, buf, off in text_blocks(batch.column(batch.num_columns - 1))]
            if parts:
                p = np.concatenate(parts)
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(p.sum(axis=1)), pa.array((p > 0.5).sum(axis=1).astype(np.int64)), pa.array(p[:, 0] > 0.5)],
                                                 [*batch.schema.names[:-1], "expected_severity", "grade", "toxic"])
    return task


def severity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, expected_severity, grade and toxic of every row of docs (doc_id, text)."""
    model = trained(small_batches(docs), labels)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_graded(model), "doc_id long, expected_severity double, grade long, toxic boolean")


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are not toxic, with all their columns."""
    model = trained(small_batches(docs), labels)
    at = docs.columns.index("text")

    def task(batches):
        for batch in batches:
            parts = [model.scores(*features(buf, off))[:, 0] <= 0.5 for _, _, buf, off in text_blocks(batch.column(at))]
            if parts:
                yield batch.filter(pa.array(np.concatenate(parts)))

    return docs.mapInArrow(task, docs.schema)
