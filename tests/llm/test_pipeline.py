"""The pipeline's stages against brute force on what each one reads."""

import re

import corpus_pipeline
from test_text_operators import components_by_hand

from vellumflow.llm.shared import cut, table


def test_stages(spark, sf):
    docs = table(spark, sf, "documents")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = cut(stage(spark, docs, sf), "test-stage")
        kept[name] = (docs.collect(), out.collect())
        if stage is not corpus_pipeline.STAGES[-1][1]:
            assert out.columns == docs.columns
        docs = out
    labels = {r.doc_id: r.quality for r in table(spark, sf, "labels").collect()}
    before, after = kept["quality classifier"]
    ids = {r.doc_id for r in after}
    assert all(d in ids for d, q in labels.items() if q == 1) and sum(d in ids for d, q in labels.items() if q == 0) < 0.3 * sum(q == 0 for q in labels.values())
    before, after = kept["exact dedup"]
    norm = lambda r: re.sub(r"[\x20\x09-\x0D]", "", r.text or "")
    best = {}
    for r in before:
        best[norm(r)] = min(best.get(norm(r), (1, 1)), (-len(r.text), r.doc_id))
    assert {r.doc_id for r in after} == {b[1] for b in best.values()} and len(after) == len(best)
    before, after = kept["n-gram Jaccard join"]
    want = components_by_hand({r.doc_id: r.text for r in before})
    assert {r.doc_id for r in after} == {d for d in want if want[d][1] == d}
    before, after = kept["mixing sources"]
    assert {r.doc_id for r in after} <= {r.doc_id for r in before} and len(after) > 0
    before, after = kept["SentencePiece ids"]
    assert len(before) == len(after) and all(r.n_tokens * 4 == len(r.ids) for r in after)
    assert corpus_pipeline.run(spark, sf).count() == len(after)
