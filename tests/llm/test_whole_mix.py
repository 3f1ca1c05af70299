"""The pipeline's mix takes whole documents, and misses a source's words by half a document a shard at most."""

from collections import Counter

import corpus_pipeline

from meshwright.llm import mixing


def test_no_text_is_cut(spark, docs):
    plan = mixing.mix(docs, scatter=False).collect()
    out = corpus_pipeline.mix(spark, docs, "").collect()
    texts = {r["text"] for r in docs.collect()}
    assert out and all(r["text"] in texts for r in out) and all(r["n_chars"] == len(r["text"]) for r in out)
    want, cut = Counter(), Counter()
    for r in plan:
        if r["taken"]:
            want[r["id"]] += (2 * r["taken"] + r["size"]) // (2 * r["size"])
            cut[r["source"]] += r["taken"] % r["size"] > 0
    assert Counter(r["doc_id"] for r in out) == +want
    assert any(cut.values()) and max(cut.values()) == 1  # one shard each here
