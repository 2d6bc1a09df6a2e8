"""Language-model scoring, whitening and periodic runs against plain versions."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from ledgerlark.llm import ngram_lm, periodic, registry, whitening
from ledgerlark.llm.packed import pack, unpack
from tests.llm import brute
from tests.llm.test_operators import docs, empty, pairs, table  # noqa: F401

DIGEST = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
SCORED = ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def test_packed():
    r = np.random.default_rng(2)
    arrays = [np.zeros(0, np.int64), np.arange(10), r.integers(0, 2**64, 5000, np.uint64), np.ones(3000, bool), np.array([2**64 - 1], np.uint64), np.zeros(7, np.int64)]
    for a, b in zip(arrays, unpack(pack(arrays)), strict=True):
        assert b.dtype == np.uint64 and a.astype(np.uint64).tolist() == b.tolist()


def test_runs_table(spark, sf_dir):
    got = registry.op13_periodic_runs(spark, sf_dir)
    rows = Counter(tuple(r[c] for c in DIGEST) for r in got.collect())
    assert rows == Counter(brute.run_digest(d, t) for d, t in pairs(table(spark, sf_dir, "documents"))) and sum(r[1] > 0 for r in rows) > 10


def test_runs_of_random_words():
    r = random.Random(4)
    for _ in range(3000):
        rows = []
        for _ in range(r.randint(1, 4)):
            words = [r.randrange(r.randint(1, 4)) for _ in range(r.randint(0, 70))]
            a, p = r.randrange(len(words) + 1), r.randint(1, 12)
            rows.append(words[: a + p] + [words[a + i % p] for i in range(r.randint(0, 60))] if len(words) >= a + p else words)
        h = np.array([x * 7919 % 13 for w in rows for x in w], np.uint64)
        got = periodic.runs_of_block(h, np.cumsum([0, *map(len, rows)]))
        assert [got.get(k, []) for k in range(len(rows))] == [brute.periodic_runs(w) for w in rows]


def test_runs_edges(spark, docs, empty):  # noqa: F811
    more = [(100, "go " * 5), (101, "go " * 6), (102, "a b " * 4), (103, "a b " * 3 + "a"), (104, ("x " * 7 + "y ") * 5), (105, "\x0bq\x0cq\r\nq\tq q q  "), (106, "w\x00 " * 9), (107, " ".join(map(str, range(3000))) + " x" * 20_000)]
    for table in (docs, spark.createDataFrame(more, "doc_id long, text string")):
        found = periodic.find(table)
        want = Counter()
        for d, t in pairs(table):
            words = brute.PLAIN_WORD.findall(t or "")
            runs = [(3000, 20_000, 1)] if d == 107 else [] if len(words) == 30_000 else brute.periodic_runs(words)  # long texts of known runs
            lost = {i for s, n, q in runs for i in range(s + q, s + n)}
            want[d, len(words), tuple(runs), " ".join(w for i, w in enumerate(words) if i not in lost)] += 1
        assert Counter((r.doc_id, r.n_words, tuple(tuple(x) for x in r.runs), r.collapsed) for r in found.collect()) == want
    got = periodic.digests(periodic.find(periodic.looped(docs)))
    assert {tuple(r[c] for c in DIGEST) for r in got.where("n_runs < 100").collect()} <= {brute.run_digest(d, t) for d, t in set(pairs(docs)) if len(t or "") < 50_000} | {
        tuple(r[c] for c in DIGEST) for r in got.where("doc_id in (7, 8)").collect()}
    assert got.count() == docs.count() and periodic.digests(periodic.find(periodic.looped(empty))).count() == 0


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_model_table(spark, sf_dir, order):
    docs = table(spark, sf_dir, "documents")
    got = sorted(tuple(r[c] for c in SCORED) for r in ngram_lm.scored(docs, order).collect())
    model = brute.Interpolated(pairs(docs), order)
    assert all(b >= a - 1e-9 for a, b in zip(model.course, model.course[1:]))
    for a, b in zip(got, sorted(model.rows), strict=True):
        assert a[:5] == b[:5] and math.isclose(a[5], b[5], rel_tol=1e-9) and math.isclose(a[6], b[6], rel_tol=1e-9)


def test_model_beats_single_words(spark):
    rows = registry.op11_interpolated_lm(spark, "/root/testdata/sf0.01").where("held_out").collect()
    assert rows and sum(r.score for r in rows) > 0.75 * sum(r.base_score for r in rows)


def test_model_chunks(spark, docs, empty, monkeypatch):  # noqa: F811
    """The same scores whatever the chunks, texts that span them included; tasks get the size as an argument."""
    key = lambda r: tuple(str(r[c]) if i < 5 else round(r[c], 6) for i, c in enumerate(SCORED))
    more = docs.select("doc_id", "text", "source").union(table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text", "source"))
    want = Counter(key(r) for r in ngram_lm.scored(more).collect())
    assert sum(want.values()) == more.count()
    monkeypatch.setattr(ngram_lm, "CHUNK", 1700)
    monkeypatch.setattr(ngram_lm, "LARGE_CHUNK", 1700)
    assert Counter(key(r) for r in ngram_lm.scored(more).collect()) == want
    assert ngram_lm.scored(empty).count() == 0
    alone = ngram_lm.scored(spark.createDataFrame([(None, "a b"), (None, None)], "doc_id long, text string")).collect()
    assert sorted((r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in alone) == [(1, 0, 0, 0.0, 0.0), (3, 0, 0, 0.0, 0.0)]


def whole(vectors):
    x = np.floor(1024 * np.array(vectors, np.float64)).astype(np.int64) + 100_000
    return x, [int(v) for v in x.sum(axis=0)]


def test_whitening_table(spark):
    sf_dir = "/root/testdata/sf0.01"
    vectors = {r.vec_id: r.embedding for r in table(spark, sf_dir, "embeddings").collect()}
    x, sums = whole(list(vectors.values()))
    n = len(x)
    centred = (n * x - np.array(sums)) / n
    values, columns = np.linalg.eigh(centred.T @ centred / n)
    want = centred @ columns[:, ::-1][:, :8] / np.sqrt(values[::-1][:8])
    got = {(r.vec_id, r.component): r for r in registry.op12_whitening(spark, sf_dir).collect()}
    assert len(got) == 8 * n and {r.n for r in got.values()} == {n} and max(r.identity_error for r in got.values()) < 1e-9
    for k in range(8):
        have = np.array([got[i, k + 1].whitened for i in vectors])
        assert min(np.abs(have - want[:, k]).max(), np.abs(have + want[:, k]).max()) < 1e-6
        assert math.isclose(got[next(iter(vectors)), k + 1].explained, values[::-1][k] / values.sum(), rel_tol=1e-9)
    for i, v in zip(vectors, x.tolist(), strict=True):
        assert got[i, 1].deviation == sum((n * a - s) ** 2 for a, s in zip(v, sums, strict=True))


def test_whitening_edges(spark):
    schema = "vec_id long, embedding array<double>, label int, x int, whitened string"
    put = lambda rows: spark.createDataFrame([(i, v, 1, 2, "s") for i, v in rows], schema)
    bad = [(1, None), (2, [1.0, None, 2.0]), (3, [1.0, float("nan"), 2.0]), (4, [float("inf"), 1.0, 2.0]), (5, []), (6, [1.0]), (None, [0.5, 0.25, -1.0]), (8, [0.5, 0.25, -1.0]), (9, [1.0, -2.0, 3.0]), (9, [3.0, 0.0, 0.0]), (10, [9.0, 1.0, 1.0])]
    got = whitening.components(put(bad)).collect()
    assert Counter(r.vec_id for r in got) == {None: 3, 8: 3, 9: 6, 10: 3} and {r.n for r in got} == {5} and got[0].identity_error < 1e-9
    assert whitening.components(put([(1, [1.0, 2.0])] * 3)).count() == 0 and whitening.components(put([(1, [1.0, 2.0])])).count() == 0 and whitening.components(put([])).count() == 0
    flat = whitening.components(put([(i, [float(i), 2.0 * i, 5.0]) for i in range(20)])).collect()
    assert {r.component for r in flat} == {1} and math.isclose(flat[0].explained, 1)
    assert whitening.squares(np.array([[2**40, 1], [3, 4]])).tolist() == [None, 25] and whitening.squares(np.array([[2**31, 5]])).tolist() == [2**62 + 25]
