"""Rows keep their numbers when later scans split the table otherwise, as they do when executors come or go."""

from collections import Counter

import pytest
from test_documents import both, removed

from meshwright.llm import mixing, simhash, suffix_dedup


SPLITS = "spark.sql.files.minPartitionNum"


@pytest.fixture
def other_splits(spark, monkeypatch):
    """Has every scan after a checkpoint read the files in another number of splits than before."""
    def patched(cut):
        def changed(df):
            out = cut(df)
            spark.conf.set(SPLITS, "1")
            return out

        return changed

    for module in (mixing, simhash, suffix_dedup):
        monkeypatch.setattr(module, "cut", patched(module.cut))
    spark.conf.set(SPLITS, "4")
    yield
    spark.conf.unset(SPLITS)


def test_repeats(docs, other_splits):
    rows = both(docs)
    want = Counter((i, *x) for (i, _), x in zip(rows, removed([t for _, t in rows], 400)))
    assert Counter(tuple(r) for r in suffix_dedup.removal_report(docs).collect()) == want


def test_near_duplicates(spark, docs, other_splits):
    groups = {(r["id"], r["root"]) for r in simhash.near_duplicate_groups(docs).collect()}
    spark.conf.set(SPLITS, "4")
    kept = simhash.keep_one_of_each(docs).collect()
    assert len(kept) == len({root for _, root in groups})
    assert len({root for r in kept for i, root in groups if i == r["doc_id"] and i is not None}) == sum(r["doc_id"] is not None for r in kept)


def test_mix(spark, docs, other_splits):
    taken = Counter(map(repr, mixing.mix(docs).collect()))
    assert Counter(map(repr, mixing.mix(docs).collect())) == taken  # read in one split now
    copies = Counter(r["doc_id"] for r in mixing.repeat_rows(docs).collect())
    spark.conf.set(SPLITS, "4")
    assert Counter(r["doc_id"] for r in mixing.repeat_rows(docs).collect()) == copies
