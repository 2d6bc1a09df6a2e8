"""The pipeline against brute-force versions of its stages, each over what its predecessor kept."""

from collections import Counter

import corpus_pipeline as pipeline
from ledgerlark.llm import secrets
from tests.llm import brute
from tests.llm.test_operators import check_packing, pairs, table


def test_stages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    columns = docs.columns
    items = [(r.item_id, r.text) for r in table(spark, sf_dir, "benchmark").collect()]
    for name, stage in pipeline.STAGES:
        before = docs.cache()
        docs = stage(spark, before, sf_dir)
        if name == "best_fit_packing":
            check_packing(docs.collect(), pairs(before))
            continue
        assert docs.columns == columns
        had, has = pairs(before), pairs(docs)
        assert has
        if name == "toxicity":
            toxic = {r.doc_id for r in table(spark, sf_dir, "labels").where("toxic = 1").collect()}
            # eleven toxic labels train little; test_toxicity_folds has the accuracy with more of them
            assert len({d for d, _ in had} & toxic) == 11 and len({d for d, _ in has} & toxic) <= 4 and len(has) > 0.85 * len(had)
        if name == "ngram_jaccard_join":
            assert Counter(d for d, _ in has) == Counter(d for d, _, c in brute.components(had, 5, 80) if c == d)
        if name == "benchmark_decontamination":
            assert Counter(d for d, _ in has) == Counter(r[0] for r in brute.decontaminated(had, items) if not r[5])
        if name == "secret_scans":
            assert [d for d, _ in sorted(had)] == [d for d, _ in sorted(has)] and not any(k != 2 for _, t in has for _, k, _ in brute.base_spans(t))
            old = dict(had)
            changed = [d for d, t in has if t != old[d]]
            assert all(brute.base_spans(old[d]) or secrets.TOKEN.search(old[d]) for d in changed)


def test_run(spark, sf_dir):
    rows = pipeline.run(spark, sf_dir)
    assert rows.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and rows.count() > 100
