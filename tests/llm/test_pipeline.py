"""The pipeline's stages on the smallest tables, each held against a brute-force reading of its own input."""

import itertools

import corpus_pipeline

from loam.llm.common import table, written
from loam.llm.surrogates import Detector

DIR = "/root/testdata/sf0.001"


def test_stages(spark):
    docs, at = table(spark, DIR, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = written(stage(spark, docs, DIR), name)
        at[name] = (docs.collect(), out.collect())
        assert name == "mixing" or out.columns == docs.columns
        docs = out
    before, after = at["language_id"]
    assert len(after) >= 0.99 * len(before)
    before, after = at["near_dedup"]
    shingles = {}
    for r in before:
        w = r.text.lower().split()
        shingles[r.doc_id] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    alike = [(a, b) for a, b in itertools.combinations(sorted(shingles), 2) if len(shingles[a] & shingles[b]) >= 0.8 * len(shingles[a] | shingles[b])]
    kept = {r.doc_id for r in after}
    assert alike and not any(a in kept and b in kept for a, b in alike)
    assert set(shingles) - kept <= {b for _, b in alike}
    before, after = at["decontamination"]
    from test_operators import _contaminated

    bench = [(r.item_id, r.text) for r in table(spark, DIR, "benchmark").collect()]
    hit = {i for i, _, n, _ in _contaminated([(r.doc_id, r.text) for r in before], bench) if n}
    assert {r.doc_id for r in after} == {r.doc_id for r in before} - hit
    before, after = at["pii"]
    find, new = Detector(), {r.doc_id: r.text for r in after}
    for r in before:
        for x in find(r.text):
            assert x.kind == "secret" or r.text[x.start : x.end] not in new[r.doc_id]
        assert find(r.text) or new[r.doc_id] == r.text
    before, after = at["mixing"]
    assert {r.copy for r in after} <= {1, 2} and {r.doc_id for r in after} <= {r.doc_id for r in before}
