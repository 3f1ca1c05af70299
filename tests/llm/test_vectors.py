"""Vector links against brute force."""

from collections import Counter

import numpy as np

from meshwright.llm import embedding_dedup


def test_links(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 7)
    random = np.random.default_rng(1)
    centres = random.normal(size=(4, 8))
    rows = [(k, [float(x) for x in centres[k % 4] + 0.12 * random.normal(size=8)], k % 3) for k in range(90)]
    rows += [(100, rows[0][1], 0), (100, rows[0][1], 0), (None, rows[3][1], 0), (101, None, 0), (102, [0.0] * 8, 0), (103, [float("nan")] + [1.0] * 7, 0), (104, [None] + [1.0] * 7, 0), (105, rows[1][1], None), (106, [1.0, 2.0], 0), (107, [], 0), (108, [2 * x for x in rows[0][1]], 0)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")

    def fit(v):
        return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)

    def linked(a, b):
        if a[2] is None or a[2] != b[2] or not fit(a[1]) or not fit(b[1]) or len(a[1]) != len(b[1]):
            return False
        x, y = np.array(a[1]), np.array(b[1])
        return x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.93

    root = list(range(len(rows)))
    links = [0] * len(rows)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if linked(rows[i], rows[j]):
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    group = [find(i) for i in range(len(rows))]
    least = {g: min((r[0] for r, k in zip(rows, group) if k == g and r[0] is not None), default=None) for g in group}
    want = Counter((r[0], n, least[g], r[0] == least[g]) for r, n, g in zip(rows, links, group))
    assert Counter(tuple(r) for r in embedding_dedup.vector_links(df).collect()) == want
    assert embedding_dedup.vector_links(df.where("vec_id < 0")).count() == 0
