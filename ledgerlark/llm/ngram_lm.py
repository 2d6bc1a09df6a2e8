"""Deleted interpolation: n-gram estimates mixed by the frequency of their context, the weights learnt on held-out counts.

P_k(w | context of k - 1 words) = a * count(context w) / count(context) + (1 - a) * P_(k-1)(w | context without its first word); the
weight a is that of order k and of the bucket floor(log2(count(context))); below the single words stands 1 / (V + 1). Two begin marks
precede a text and one end token closes it. Rows of crc32(doc_id) % 10 = 0 are never learnt from. Weights are learnt by expectation-
maximisation on the rows of remainder `FOLD` under counts of the other training rows; scores use the counts of all training rows.

1. Texts become chunks of some millions of tokens. A chunk lists its distinct n-grams of each order as sorted hashes with their counts
   and cuts the lists by ranges of hashes; each range, a bucket, gets one row of each chunk, however common an n-gram is.
2. A bucket adds up the counts of all chunks and answers each chunk with the totals in the order of its list.
3. A chunk meets its answers: its tokens become counts of their n-grams, which are written as a table in the shared folder.
4. Each round of expectation-maximisation is one job over the written counts of fold `FOLD`; it returns two sums for each order and bucket.
5. A last job over the table gives the scores. A text that spans chunks is added up by its row.

Words are hashed to 64 bits; longer n-grams to 16 bits more than the number of bytes of all texts has, so the count of one of them is
shared with another one with a chance of less than 1 in 65,000. Chunks are made twice, for steps 1 and 3, so docs must read the same
each time (a table or a checkpoint); chunks carry a mark, and a difference raises an error.

Edge cases: a null, empty or blank text is its end token alone; a row with a null doc_id is scored and not learnt from; repeated rows
and equal doc_ids each count and give a row each; a very long text is split over chunks; without training rows every token has
the chance 1 / (V + 1) = 1; an order or bucket that fold `FOLD` never meets takes the weight of the next lower bucket that it meets, or
one half; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlark.llm.common import LOWER, mixed, new_folder, padded, small_batches, span_hash, spans, text_blocks
from ledgerlark.llm.packed import joined, pack, packed, unpack

ORDER, FOLD, ROUNDS, ENOUGH = 3, 1, 30, 1e-6
#: Tokens of a chunk, at least and at most, bytes of text that a bucket stands for, and tokens that are scored at a time.
CHUNK, LARGE_CHUNK, BUCKET, PART = 1 << 21, 1 << 24, 1 << 26, 1 << 18
SPARE_BITS, CLASSES = 16, 65
BEGIN, END = np.uint64(0x9AE16A3B2F90404F), np.uint64(0xC3A5C85C97CB3127)
_MIX = np.uint64(0xD6E8FEB86659FD93)


class Chunk:
    """Tokens of consecutive rows, a piece for each row: `lead` positions of context, then what is scored."""

    def __init__(self, name: int, lead: int):
        self.name, self.lead = name, lead
        self.words: list[np.ndarray] = []
        self.pieces: list[tuple] = []  # row, doc_id, remainder, tokens, whether the text begins here
        self.tokens = 0

    def add(self, context: np.ndarray, words: np.ndarray, *piece) -> None:
        self.words += [context, words]
        self.pieces.append((*piece[:3], len(words), piece[3]))
        self.tokens += len(words)

    def sealed(self) -> Chunk:
        self.h, self.words = np.concatenate(self.words), []
        sizes = np.array([p[3] for p in self.pieces])
        self.scored = np.ones(len(self.h), bool)
        begin = np.cumsum(sizes + self.lead) - sizes - self.lead
        for k in range(self.lead):
            self.scored[begin + k] = False
        self.held = self.scored.copy()  # positions with an entry: what is scored, and the last of the context
        self.held[begin + self.lead - 1] = True
        self.remainder = np.repeat(np.array([p[2] for p in self.pieces], np.int8), sizes + self.lead)
        return self

    def keys(self, order: int, bits: int) -> np.ndarray:
        """The hash of the n-gram that ends at each entry. Entries of a context have none of the highest order that means anything."""
        g = self.h
        for _ in range(order - 1):
            g = np.concatenate([g[:1], mixed(g[:-1] * _MIX + self.h[1:])])
        g = g[self.held]
        return g if order == 1 else g >> np.uint64(64 - bits)

    def mark(self) -> int:
        return int(mixed(self.h + np.arange(len(self.h), dtype=np.uint64)).sum().view(np.int64))


def chunks(batches, size: int, order: int) -> Iterator[Chunk]:
    """The chunks of batches of (doc_id, remainder, text)."""
    lead = max(1, order - 1)
    name = TaskContext.get().partitionId() << 32
    chunk, row = Chunk(name, lead), name << 8
    for batch in batches:
        ids, remainders = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for i, j, buf, off in text_blocks(batch.column(2)):
            s, e, first = spans(buf, off)
            h = span_hash(padded(LOWER[buf]), s, e)
            for k in range(i, j):
                stream = np.concatenate([np.full(lead, BEGIN), h[first[k - i] : first[k - i + 1]], [END]])
                at = lead
                while at < len(stream):
                    end = min(len(stream), at + size - chunk.tokens)
                    chunk.add(stream[at - lead : at], stream[at:end], row, ids[k], remainders[k], at == lead)
                    at = end
                    if chunk.tokens >= size:
                        yield chunk.sealed()
                        name += 1
                        chunk = Chunk(name, lead)
                row += 1
    if chunk.pieces:
        yield chunk.sealed()


def _ranked(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in rising order, and the place of each key among them."""
    order = np.argsort(keys)
    ranked = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    place = np.empty(len(keys), np.uint32)
    place[order] = np.cumsum(new, dtype=np.uint32) - np.uint32(1)
    return ranked[new], place


#: How often an n-gram stands in rows that are learnt from, in rows of fold FOLD, and whether a row of that fold asks for it.
_COMMON = ((0, 0, 0), (1, 0, 0), (0, 1, 1))


def _coded(learnt: np.ndarray, tuned: np.ndarray, asked: np.ndarray) -> list[np.ndarray]:
    """The three numbers of every n-gram as one code for each common case, and in full for the others."""
    code = np.full(len(learnt), len(_COMMON), np.uint8)
    for k, (a, b, c) in enumerate(_COMMON):
        code[(learnt == a) & (tuned == b) & (asked == c)] = k
    rest = code == len(_COMMON)
    return [code, learnt[rest], tuned[rest], asked[rest]]


def _decoded(code: np.ndarray, *rest: np.ndarray) -> tuple[np.ndarray, ...]:
    code = code.astype(np.uint8)
    out = tuple(np.array([*(x[k] for x in _COMMON), 0], np.int64)[code] for k in range(3))
    for x, r in zip(out, rest, strict=True):
        x[code == len(_COMMON)] = r
    return out


def _limits(buckets: int, bits: int) -> np.ndarray:
    return np.array([-(-(b << bits) // buckets) for b in range(1, buckets)], np.uint64)


def _requests(size: int, order: int, bits: int, buckets: int):
    def task(batches):
        for c in chunks(batches, size, order):
            scored, fold = c.scored[c.held], c.remainder[c.held]
            lists = []
            for k in range(1, order + 1):
                keys, place = _ranked(c.keys(k, bits))
                counts = [np.bincount(place[rows], minlength=len(keys)).astype(np.uint32) for rows in (scored & (fold > 0) & (fold != FOLD), scored & (fold == FOLD), fold == FOLD)]
                cuts = [0, *np.searchsorted(keys, _limits(buckets, 64 if k == 1 else bits)).tolist(), len(keys)]
                lists.append((keys, *counts[:2], counts[2] > 0, cuts))
            mark, name = c.mark(), c.name
            del c, scored, fold, place, counts
            for b in range(buckets):
                arrays = []
                for keys, learnt, tuned, asked, cuts in lists:
                    part = slice(cuts[b], cuts[b + 1])
                    arrays += [np.diff(keys[part], prepend=np.uint64(0)), *_coded(learnt[part], tuned[part], asked[part])]
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([name]), pa.array([mark]), pa.array([pack(arrays)], pa.binary())], ["bucket", "chunk", "mark", "data"])
            del lists, keys, learnt, tuned, asked

    return task


_ANSWER = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("mark", pa.int64()), ("words", pa.int64()), ("words_learnt", pa.int64()), ("data", pa.binary())])


def _answers(order: int):
    def total(key, table):
        rows = [unpack(x) for x in table["data"].to_pylist()]
        answers: list[list[np.ndarray]] = [[] for _ in rows]
        words = [0, 0]
        for k in range(order):
            keys = [np.cumsum(r[5 * k]) for r in rows]
            counts = [_decoded(*r[5 * k + 1 : 5 * k + 5]) for r in rows]
            cuts = np.cumsum([0, *map(len, keys)])
            distinct, back = _ranked(np.concatenate(keys))
            some = np.bincount(back, np.concatenate([x[0] for x in counts]), len(distinct)).astype(np.int64)
            every = some + np.bincount(back, np.concatenate([x[1] for x in counts]), len(distinct)).astype(np.int64)
            if k == 0:
                words = [int((every > 0).sum()), int((some > 0).sum())]
            for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                answers[i] += [every[back[a:b]], some[back[a:b][counts[i][2] > 0]]]
        data = [pack(x) for x in answers]
        n, b = len(rows), key[0].as_py()
        chunk, mark, none = table["chunk"].to_pylist(), table["mark"].to_pylist(), b""
        return pa.table([pa.array([*chunk, -1 - b]), pa.array([b] * (n + 1), pa.int32()), pa.array([*mark, 0]), pa.array([0] * n + words[:1]), pa.array([0] * n + words[1:]), pa.array([*data, none], pa.binary())], schema=_ANSWER)

    return total


def _sequences(size: int, order: int):
    def task(batches):
        for c in chunks(batches, size, order):
            distinct, back = _ranked(c.h)
            common = np.argsort(-np.bincount(back), kind="stable").astype(np.uint32)
            rank = np.empty(len(common), np.uint32)
            rank[common] = np.arange(len(common), dtype=np.uint32)
            row, doc, remainder, tokens, begins = (list(x) for x in zip(*c.pieces, strict=True))
            null = np.array([d is None for d in doc])
            ids = np.array([d or 0 for d in doc], np.int64).view(np.uint64)
            data = pack([np.diff(distinct, prepend=np.uint64(0)), common, rank[back], np.array(row), ids, null, np.array(remainder), np.array(tokens), np.array(begins)])
            yield pa.RecordBatch.from_arrays([pa.array([c.name]), pa.array([-1], pa.int32()), pa.array([c.mark()]), pa.array([0]), pa.array([0]), pa.array([data], pa.binary())], schema=_ANSWER)

    return task


def _restored(name: int, data: bytes, lead: int) -> Chunk:
    gaps, common, ranks, row, ids, null, remainder, tokens, begins = unpack(data)
    c = Chunk(name, lead)
    c.words = [np.cumsum(gaps)[common.astype(np.uint32)][ranks.astype(np.uint32)]]
    del ranks
    doc = [None if x else d for d, x in zip(ids.view(np.int64).tolist(), null.tolist(), strict=True)]
    c.pieces = list(zip(row.tolist(), doc, remainder.tolist(), tokens.tolist(), begins.astype(bool).tolist(), strict=True))
    return c.sealed()


_COUNTED = pa.schema([*((n, pa.int64()) for n in ("words", "words_learnt", "tokens", "tokens_learnt", "texts", "texts_learnt")), ("pieces", pa.binary()), ("counts", pa.binary()), ("tuning", pa.binary())])


def _counted(order: int, bits: int):
    """The counts of a chunk's tokens: `counts` under all training rows, `tuning` of fold FOLD under the other ones."""

    def meet(key, table):
        table = table.sort_by("bucket")
        if key[0].as_py() < 0:  # a bucket's number of words
            return pa.table([table["words"], table["words_learnt"], *([pa.array([0])] * 4), *([pa.array([b""], pa.binary())] * 3)], schema=_COUNTED)
        data, marks = table["data"].to_pylist(), table["mark"].to_pylist()
        c = _restored(key[0].as_py(), data[0], max(1, order - 1))
        if table["bucket"][0].as_py() != -1 or len(set(marks)) > 1 or c.mark() != marks[0]:
            raise RuntimeError("documents gave other rows when they were read again: pass a table or a checkpoint")
        answers = [unpack(x) for x in data[1:]]
        fold = c.remainder[c.held]
        scored = c.scored[c.held]
        tuned = fold == FOLD
        every, some = [], []
        for k in range(order):
            distinct, back = _ranked(c.keys(k + 1, bits))
            wants = np.zeros(len(distinct), bool)
            wants[back[tuned]] = True
            counts = np.concatenate([a[2 * k] for a in answers])
            part = np.zeros(len(distinct), np.uint64)
            part[wants] = np.concatenate([a[2 * k + 1] for a in answers])
            if len(counts) != len(distinct):
                raise RuntimeError("documents gave other rows when they were read again: pass a table or a checkpoint")
            width = np.uint32 if not len(counts) or counts.max() < 2**32 else np.uint64
            every.append(packed(counts.astype(width)[back]))
            some.append(packed(part.astype(width)[back[tuned]]))
            del distinct, back, wants, counts, part
        row, doc, remainder, tokens, begins = (list(x) for x in zip(*c.pieces, strict=True))
        null = np.array([d is None for d in doc])
        ids = np.array([d or 0 for d in doc], np.int64).view(np.uint64)
        pieces = [np.array(row), ids, null, np.array(remainder), np.array(tokens), np.array(begins)]
        at = np.array(remainder) == FOLD
        learnt = scored & (fold > 0)
        sums = [0, 0, int(learnt.sum()), int((learnt & ~tuned).sum())]
        first = np.array(begins) & (np.array(remainder) > 0)
        sums += [int(first.sum()), int((first & ~at).sum())]
        return pa.table([*(pa.array([x]) for x in sums), pa.array([pack(pieces)], pa.binary()), pa.array([joined(every)], pa.binary()),
                         pa.array([joined([packed(pieces[4][at]), packed(pieces[5][at]), *some])], pa.binary())], schema=_COUNTED)

    return meet


def _begins(tokens: np.ndarray) -> np.ndarray:
    """The index of each piece's entry of context."""
    return np.cumsum(tokens + 1) - tokens - 1


def _parts(counts: list[np.ndarray], tokens: np.ndarray, begins: np.ndarray) -> Iterator[tuple[slice, list[np.ndarray], np.ndarray, np.ndarray]]:
    """Runs of pieces of some `PART` tokens (a longer piece is one alone): which pieces, and what belongs to them."""
    ends = np.cumsum(tokens + 1)
    a = 0
    while a < len(tokens):
        low = ends[a] - tokens[a] - 1
        b = max(a + 1, int(np.searchsorted(ends, low + PART, "right")))
        yield slice(a, b), [c[low : ends[b - 1]] for c in counts], tokens[a:b], begins[a:b]
        a = b


class Mixture:
    """The weights, and the chances they give to entries of counts."""

    def __init__(self, weights: np.ndarray, tokens: int, texts: int, words: int):
        self.weights, self.tokens, self.texts, self.words = weights, tokens, texts, words

    def levels(self, counts: list[np.ndarray], tokens: np.ndarray, begins: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(order - 1, class of the context, maximum-likelihood estimate, weight) of all scored entries."""
        lead = _begins(tokens)
        scored = np.ones(len(counts[0]), bool)
        scored[lead] = False
        at = np.flatnonzero(scored)
        above = np.full(len(at), float(self.tokens))
        for k, own in enumerate(counts):
            own = own.astype(np.float64)
            kind = np.frexp(above)[1] * (above > 0)  # 0: never met; else 1 + floor(log2)
            yield k, kind, np.divide(own[at], above, out=np.zeros(len(at)), where=above > 0), np.where(above > 0, self.weights[k][kind], 0)
            own[lead[begins]] = self.texts
            above = own[at - 1]

    def chances(self, counts: list[np.ndarray], tokens: np.ndarray, begins: np.ndarray) -> np.ndarray:
        p = np.full(int(tokens.sum()), 1 / (self.words + 1))
        for _, _, estimate, weight in self.levels(counts, tokens, begins):
            p = weight * estimate + (1 - weight) * p
        return p

    def expected(self, counts: list[np.ndarray], tokens: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """For each order and class: how often its estimate is expected to be the source, and how often it could be; log-likelihood."""
        below = np.full(int(tokens.sum()), 1 / (self.words + 1))
        kept = []
        for k, kind, estimate, weight in self.levels(counts, tokens, begins):
            whole = weight * estimate + (1 - weight) * below
            kept.append((k, kind, weight * estimate / whole))
            below = whole
        used, tried = np.zeros((2, len(counts), CLASSES))
        reach = np.ones(len(below))
        for k, kind, share in reversed(kept):
            used[k] += np.bincount(kind, reach * share, CLASSES)
            tried[k] += np.bincount(kind, reach, CLASSES)
            reach = reach * (1 - share)
        return used, tried, float(np.log(below).sum())


def _learnt(table: DataFrame, order: int, tokens: int, texts: int, words: int) -> tuple[np.ndarray, list[float]]:
    """Weights (order, class) by expectation-maximisation, and the mean log-likelihood of each round."""
    weights, course = np.full((order, CLASSES), 0.5), []
    rows = table.where("length(tuning) > 0").select("tuning")
    for _ in range(ROUNDS):
        model = Mixture(weights, tokens, texts, words)

        def task(batches, model=model):
            used, tried, gain, n = np.zeros((order, CLASSES)), np.zeros((order, CLASSES)), 0.0, 0
            for batch in batches:
                for data in batch.column(0).to_pylist():
                    tokens, begins, *counts = unpack(data)
                    for _, part, sizes, first in _parts(counts, tokens.astype(np.int64), begins.astype(bool)):
                        u, t, g = model.expected(part, sizes, first)
                        used, tried, gain, n = used + u, tried + t, gain + g, n + int(sizes.sum())
            at = np.flatnonzero(tried.ravel())
            yield pa.RecordBatch.from_arrays([pa.array([-1, *at.tolist()], pa.int32()), pa.array([gain, *used.ravel()[at].tolist()]), pa.array([float(n), *tried.ravel()[at].tolist()])], ["place", "used", "tried"])

        found = {r.place: r for r in rows.mapInArrow(task, "place int, used double, tried double").groupBy("place").agg(F.sum("used").alias("used"), F.sum("tried").alias("tried")).collect()}
        if -1 not in found or not found[-1].tried:
            break
        course.append(found[-1].used / found[-1].tried)
        weights = np.full((order, CLASSES), 0.5)
        for k in range(order):
            for c in range(1, CLASSES):
                r = found.get(k * CLASSES + c)
                weights[k, c] = (r.used + 0.5) / (r.tried + 1) if r else weights[k, c - 1]
        if len(course) > 1 and course[-1] - course[-2] < ENOUGH * abs(course[-2]):
            break
    return weights, course


def scored(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score (single words, smoothed by addition) and score of every row of docs (doc_id, text)."""
    spark = docs.sparkSession
    remainder = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 10, F.lit(0)).cast("int")
    rows = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), remainder.alias("remainder"), F.col("text").cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(64, max(40, size.bit_length() + SPARE_BITS))
    chunk = min(LARGE_CHUNK, max(CHUNK, size // 6000))
    buckets = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), size // BUCKET)
    asked = rows.mapInArrow(_requests(chunk, order, bits, buckets), "bucket int, chunk long, mark long, data binary")
    schema = "chunk long, bucket int, mark long, words long, words_learnt long, data binary"
    answers = asked.groupBy("bucket").applyInArrow(_answers(order), schema)
    both = rows.mapInArrow(_sequences(chunk, order), schema).unionByName(answers)
    names = ", ".join(f"{f.name} {'binary' if f.type == pa.binary() else 'long'}" for f in _COUNTED)
    folder = new_folder(spark, "ngram-counts")
    both.groupBy("chunk").applyInArrow(_counted(order, bits), names).write.parquet(folder)
    table = spark.read.parquet(folder)
    t = table.agg(*(F.coalesce(F.sum(f.name), F.lit(0)).alias(f.name) for f in _COUNTED if f.type == pa.int64())).first()
    weights, _ = _learnt(table, order, t.tokens_learnt, t.texts_learnt, t.words_learnt)
    model = Mixture(weights, t.tokens, t.texts, t.words)

    def task(batches):
        for batch in batches:
            for pieces, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                row, ids, null, remainder, tokens, begins = unpack(pieces)
                for at, counts, sizes, first in _parts(unpack(data), tokens.astype(np.int64), begins.astype(bool)):
                    own = np.ones(len(counts[0]), bool)
                    own[_begins(sizes)] = False
                    single = counts[0][own].astype(np.float64)
                    start = np.cumsum(sizes) - sizes
                    base = np.log10((single + 0.1) / (model.tokens + 0.1 * (model.words + 1)))
                    score = np.log10(model.chances(counts, sizes, first))
                    yield pa.RecordBatch.from_arrays([
                        pa.array(row[at].astype(np.int64)), pa.array(ids[at].view(np.int64), mask=null[at].astype(bool)), pa.array(remainder[at] == 0), pa.array(sizes),
                        pa.array(np.add.reduceat((single > 0).astype(np.int64), start)), pa.array(np.add.reduceat(base, start)), pa.array(np.add.reduceat(score, start))],
                        ["row", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    parts = table.where("length(pieces) > 0").select("pieces", "counts").mapInArrow(task, "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    sums = [F.first(c).alias(c) for c in ("doc_id", "held_out")] + [F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")]
    out = parts.groupBy("row").agg(*sums)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(t.tokens).cast("long").alias("train_tokens"), "base_score", "score")
