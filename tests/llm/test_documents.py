"""Operators on documents against brute force, on a fixture of awkward rows."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from meshwright.llm import bpe, katz, license_scan, mixing, quality_classifier, quality_rules, sharding, simhash, suffix_dedup
from meshwright.llm.queries import TOKENIZER

WORD = re.compile("[^\x20\x09-\x0d]+")


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def both(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


def test_quality_rules(docs, empty):
    def figures(text):
        w = words(text)
        grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        hit = {i + k for i in range(len(w) - 2) for k in range(3) if grams[tuple(w[i : i + 3])] > 1}
        seen, dup = set(), 0
        for line in (text or "").split("\n"):
            if words(line):
                dup += line in seen
                seen.add(line)
        failed = len(w) < 50 or 100 * len(hit) > 50 * len(w)
        return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(hit), failed

    found = quality_rules.repetition_report(docs).collect()
    got = Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in found)
    assert got == Counter((i, *figures(t)) for i, t in both(docs))
    assert not any(r["kept"] for r in found if r["base_failed"])
    kept = quality_rules.quality_filter(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r["kept"] for r in found)
    assert quality_rules.repetition_report(empty).count() == 0


def coverage(text, n):
    w = words(text)
    grams = Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    hit = {i + k for i in range(len(w) - n + 1) for k in range(n) if grams[tuple(w[i : i + n])] > 1}
    return sum(len(w[i]) for i in hit) / max(1, sum(map(len, w)))


def test_coverage_of_every_length(docs):
    for r in quality_rules.repetition_report(docs.where("doc_id is not null").dropDuplicates(["doc_id"])).collect():
        text = docs.where(F.col("doc_id") == r["doc_id"]).first()["text"] if r["doc_id"] in (20, 41, 51, 60, 62) else None
        for n in quality_rules.Rules().lengths if text else ():
            assert r[f"coverage_{n}"] == pytest.approx(coverage(text, n))


def fingerprint(text):
    w = words(lower(text))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))


def components(nodes, linked):
    root = list(range(len(nodes)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(nodes)):
        for j in range(i):
            if linked(nodes[i], nodes[j]):
                root[find(i)] = find(j)
    return [find(i) for i in range(len(nodes))]


def test_simhash(docs, empty):
    rows = both(docs)
    fps = [fingerprint(t) for _, t in rows]
    group = components(fps, lambda a, b: (a ^ b).bit_count() <= 2)
    least = {g: min((i for (i, _), k in zip(rows, group) if k == g and i is not None), default=None) for g in group}
    want = Counter((i, fp, least[g]) for (i, _), fp, g in zip(rows, fps, group))
    found = simhash.near_duplicate_groups(docs).collect()
    assert Counter((r["id"], r["fp"] % 2**64, r["component_id"]) for r in found) == want
    kept = simhash.keep_one_of_each(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(group))
    assert simhash.near_duplicate_groups(empty).count() == 0


@pytest.mark.parametrize("most", [1, 32])
def test_links_among_crowded_fingerprints(spark, monkeypatch, most):
    monkeypatch.setattr(simhash, "PAIRWISE_MOST", most)
    base = 0x123456789ABCDEF0
    fps = sorted({base} | {base ^ (1 << a) for a in range(20)} | {base ^ (1 << a) ^ (1 << b) for a in range(6) for b in range(40, 44)} | {(base * k * 0x9E3779B97F4A7C15) % 2**64 for k in range(2, 200)})
    signed = [(f - 2**64 if f >= 2**63 else f,) for f in fps]
    edges = simhash.near_fingerprints(spark.createDataFrame(signed, "fp bigint")).collect()
    joined = {(r["a"] % 2**64, r["b"] % 2**64) for r in edges}
    assert all((a ^ b).bit_count() <= 2 for a, b in joined)
    want = components(fps, lambda a, b: (a ^ b).bit_count() <= 2)
    got = components(fps, lambda a, b: (a, b) in joined or (b, a) in joined)
    assert len(set(want)) == len(set(got)) == len(set(zip(want, got)))


def removed(texts, length):
    data = [(t or "").encode() for t in texts]
    count = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = [False] * len(d)
        for i in range(len(d) - length + 1):
            if count[d[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        kept = bytes(c for c, g in zip(d, gone) if not g)
        out.append((len(d), sum(gone), sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("group_most", [1, 50_000])
def test_suffix_dedup(docs, empty, group_most, monkeypatch):
    monkeypatch.setattr(suffix_dedup.repeated_spans, "__defaults__", ("text", 400, group_most))
    rows = both(docs)
    want = Counter((i, *x) for (i, _), x in zip(rows, removed([t for _, t in rows], 400)))
    found = suffix_dedup.removal_report(docs).collect()
    assert Counter(tuple(r) for r in found) == want
    assert suffix_dedup.removal_report(empty).count() == 0
    cleaned = suffix_dedup.remove_repeats(docs)
    assert cleaned.columns == docs.columns and cleaned.count() == len(rows)


def test_mix(docs, empty):
    found = mixing.mix(docs).collect()
    sizes = Counter((i, len(words(t))) for i, t in both(docs))
    assert Counter((r["id"], r["size"]) for r in found) == sizes
    names = sorted({r["source"] for r in found}, key=lambda s: (s is None, s))
    size = {s: sum(r["size"] for r in found if r["source"] == s) for s in names}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, full = {}, set()
    while True:
        left = sum(size.values()) - sum(3 * size[s] for s in full)
        target = {s: 3 * size[s] if s in full else left * weight[s] / sum(weight[x] for x in names if x not in full) for s in names}
        over = {s for s in names if s not in full and target[s] > 3 * size[s]}
        if not over:
            break
        full |= over
    for s in names:
        own = [r for r in found if r["source"] == s]
        assert own[0]["target"] == pytest.approx(target[s]) and own[0]["source_size"] == size[s]
        assert sum(r["taken"] for r in own) == pytest.approx(target[s], abs=2)
    assert all(r["taken"] <= 3 * r["size"] for r in found)
    assert sorted(map(repr, found)) == sorted(map(repr, mixing.mix(docs).collect()))
    assert mixing.mix(empty).count() == 0
    front = mixing.mix(docs, scatter=False).collect()
    for s in names:
        assert sum(r["taken"] for r in front if r["source"] == s) == sum(r["taken"] for r in found if r["source"] == s)
    assert mixing.repeat_rows(docs).columns == docs.columns
    assert mixing.repeat_rows(empty).count() == 0


def test_mix_over_levels_of_shards(spark, monkeypatch):
    """Quotas that come down two levels of groups, shards of few rows, blocks that are drawn."""
    monkeypatch.setattr(mixing, "FANOUT", 4)
    rows = [(k, " ".join(["w"] * (1 + k * 37 % 90)), "abc"[k % 7 % 3]) for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    found = mixing.mix(df, shard_rows=10, most_block=8).collect()
    size, taken = Counter(), Counter()
    for r in found:
        size[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        assert 0 <= r["taken"] <= 3 * r["size"]
    target = {r["source"]: r["target"] for r in found}
    assert len(found) == 400 and sum(target.values()) == pytest.approx(sum(size.values()))
    assert all(taken[s] == pytest.approx(target[s], rel=0.02) for s in target)
    parted = [r for r in found if r["taken"] % r["size"]]
    assert len(parted) > 40  # blocks lie all over the shards' lines
    front = mixing.mix(df, shard_rows=10, most_block=8, scatter=False).collect()
    assert sum(r["taken"] % r["size"] > 0 for r in front) <= 43
    assert sorted(map(repr, found)) == sorted(map(repr, mixing.mix(df.repartition(7), shard_rows=10, most_block=8).collect()))


def test_apportion_gives_the_highest_quotients(spark):
    votes = [(k, float((k * 37) % 101 + 1)) for k in range(30)]
    df = spark.createDataFrame([("g", k, v, 101) for k, v in votes], "g string, k int, v double, seats int")
    got = {r["k"]: r["quota"] for r in mixing.apportion(df, F.col("seats"), "v", ["g"], [F.col("k")]).collect()}
    best = sorted(((-v / (2 * s + 1), k) for k, v in votes for s in range(101)))[:101]
    assert got == {k: sum(x == k for _, x in best) for k, _ in votes}


def test_sharding(docs, empty, spark):
    found = sharding.shard_documents(docs, sharding.layout(24), sharding.layout(25)).collect()
    want = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in both(docs))
    assert Counter((r["id"], r["size"], r["text_crc32"]) for r in found) == want
    for s in {r["shard"] for r in found}:
        assert sorted(r["slot"] for r in found if r["shard"] == s) == list(range(sum(r["shard"] == s for r in found)))
    assert all(r["grown_shard"] in (r["shard"], 24) for r in found)
    many = spark.range(24_000).select(sharding.assign(F.col("id"), sharding.layout(24)).alias("a"), sharding.assign(F.col("id"), sharding.layout(25)).alias("b"))
    counts = Counter((r["a"], r["b"]) for r in many.collect())
    assert all(a == b or b == 24 for a, b in counts) and 800 < sum(n for (_, b), n in counts.items() if b == 24) < 1120
    assert all(850 < sum(n for (a, _), n in counts.items() if a == s) < 1150 for s in range(24))
    assert sharding.shard_documents(empty, sharding.layout(24)).count() == 0
    heavier = sharding.layout(24)
    heavier["region0"]["rack0"][0] = 3.0
    moved = spark.range(5000).select(sharding.assign(F.col("id"), sharding.layout(24)).alias("a"), sharding.assign(F.col("id"), heavier).alias("b")).where("a != b").collect()
    assert moved and all(r["b"] < 8 for r in moved)  # only into the region whose weight grew


def test_bpe(docs, empty):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(TOKENIZER)
    library.no_truncation()
    library.no_padding()

    def encoded(text):
        ids = library.encode(text or "", add_special_tokens=False).ids
        return len(ids), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()

    more = docs.select("doc_id", "text").union(docs.sparkSession.createDataFrame([(90, "a<|endoftext|>b Don't ΣΑΣ İx 12345"), (91, "x" * 3000), (92, "á é́ ́")], "doc_id bigint, text string"))
    assert Counter(tuple(r) for r in bpe.encode(more, TOKENIZER).collect()) == Counter((i, *encoded(t)) for i, t in both(more))
    r = bpe.encode(more.where("doc_id = 90"), TOKENIZER, with_ids=True).first()
    assert r["ids"] == library.encode("a<|endoftext|>b Don't ΣΑΣ İx 12345", add_special_tokens=False).ids
    assert bpe.encode(empty, TOKENIZER).count() == 0


def test_bpe_repairs_joins(monkeypatch):
    """Chunks of a few bytes, so that cuts go through words, special tokens, letters with marks."""
    import random

    import pyarrow as pa
    from tokenizers import Tokenizer

    from meshwright.llm.text import slices

    monkeypatch.setattr(bpe, "CHUNK_BITS", 2)
    library = Tokenizer.from_file(TOKENIZER)
    library.no_truncation()
    library.no_padding()
    draw = random.Random(5)
    parts = ["a", "e", "b", " ", "  ", "\n", "'s", "Don", "<|endoftext|>", "Σ", "Α", "σ", "İ", "é", "\u0301", "日", "本", "x", "1", "."]
    texts = ["".join(draw.choice(parts) for _ in range(draw.randrange(90))) for _ in range(800)] + ["x" * 3000, ""]
    codes, found = bpe.ChunkCodes(TOKENIZER), []
    for _, _, data, offsets in slices(pa.array(texts), 20_000):
        found += bpe.encode_slice(data, offsets, codes)
    assert [ids.tolist() for ids in found] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    monkeypatch.setattr(bpe, "_agreed", lambda *_: None)  # nothing agrees: whole texts are encoded
    found = [ids.tolist() for _, _, data, offsets in slices(pa.array(texts[:50]), 20_000) for ids in bpe.encode_slice(data, offsets, codes)]
    assert found == [e.ids for e in library.encode_batch(texts[:50], add_special_tokens=False)]


@pytest.mark.parametrize("n", [1, 2, 3])
def test_katz_of_few_documents(spark, n):
    rows = [(k, t, True) for k, t in enumerate(["one", "one two one two", None][:n])]
    found = katz.score_texts(spark.createDataFrame(rows, "doc_id bigint, text string, train boolean"), "train").collect()
    assert sorted((r["id"], r["n_tokens"], r["n_known"]) for r in found) == [(0, 2, 2), (1, 5, 5), (2, 1, 1)][:n]
    assert all(r["score"] < 0 for r in found)


def test_katz(docs, empty):
    marked = docs.withColumn("train", F.coalesce(F.col("doc_id") % 3 != 1, F.lit(True)))
    rows = [(r["doc_id"], r["text"], r["train"]) for r in marked.select("doc_id", "text", "train").collect()]
    tokens = [[*words(lower(t)), None] for _, t, _ in rows]
    c = Counter(w for (*_, k), x in zip(rows, tokens) if k for w in x)
    b = Counter(p for (*_, k), x in zip(rows, tokens) if k for p in zip([0, *x[:-1]], x))
    spread = lambda counts: [0] + [sum(v == r for v in counts.values()) for r in range(1, katz.CUT + 2)]
    n, v = sum(c.values()), len(c)
    uni, two = katz.Unigrams(n, v, katz.Discounts(spread(c))), katz.Discounts(spread(b))
    p1 = lambda w: (two and (uni.discounts.factor[c[w]] if c[w] <= katz.CUT else 1) * c[w] / uni.total) if c[w] else uni.unknown
    after: dict = {}
    for (h, w), k in b.items():
        after.setdefault(h, {})[w] = k
    assert sum(p1(w) for w in c) + uni.unknown == pytest.approx(1)

    def chance(h, w):
        own = after.get(h)
        if not own:
            return p1(w)
        total = sum(own.values())
        freed = sum((1 - two.factor[k]) * k for k in own.values() if k <= katz.CUT)
        divisor, freed = (total, freed) if freed > 0 else (total + 1, 1.0)
        if w in own:
            return (two.factor[own[w]] if own[w] <= katz.CUT else 1) * own[w] / divisor
        return freed / divisor / (1 - sum(p1(x) for x in own)) * p1(w)

    for h in list(after)[:20]:
        assert sum(chance(h, w) for w in c) + chance(h, "\0") == pytest.approx(1)
    want = sorted((i is None, i or 0, len(x), sum(w in c for w in x), round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in x), 5), round(sum(math.log10(chance(h, w)) for h, w in zip([0, *x[:-1]], x)), 5)) for (i, *_), x in zip(rows, tokens))
    found = katz.score_texts(marked, "train", parts=3).collect()
    got = sorted((r["id"] is None, r["id"] or 0, r["n_tokens"], r["n_known"], round(r["base_score"], 5), round(r["score"], 5)) for r in found)
    assert all(a[:4] == b[:4] and a[4:] == pytest.approx(b[4:], abs=2e-5) for a, b in zip(got, want, strict=True))
    assert all(r["train_tokens"] == n for r in found)
    assert katz.score_texts(empty.withColumn("train", F.lit(True)), "train").count() == 0
    untrained = katz.score_texts(docs.withColumn("train", F.lit(False)), "train").collect()
    assert all(r["score"] == 0 for r in untrained)


def test_quality_classifier(spark, docs, empty):
    good = ["calm river over the stone bridge " * (3 + k % 5) + f"w{k}" for k in range(60)]
    bad = ["### BUY!! $$$ NOW!! %%% " * (3 + k % 5) + f"Q{k}" for k in range(60)]
    texts = spark.createDataFrame([(k, t) for k, t in enumerate(good + bad)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, int(k < 60)) for k in range(120) if k % 4], "doc_id bigint, quality int").union(spark.createDataFrame([(None, 1), (1, None)], "doc_id bigint, quality int"))
    settings = quality_classifier.Settings(examples=2000)
    sample = quality_classifier.labelled_sample(texts, labels, settings, "doc_id", "text", "quality")
    assert len(sample) == 90
    model = quality_classifier.train([r[0] for r in sample], [r[1] for r in sample], settings)
    scores = {r["doc_id"]: r["score"] for r in quality_classifier.score_documents(texts, model).collect()}
    assert all((scores[k] > 0.5) == (k < 60) for k in range(0, 120, 4))  # held out
    assert quality_classifier.score_documents(docs, model).where("score between 0 and 1").count() == docs.count()
    assert quality_classifier.score_documents(empty, model).count() == 0
    assert quality_classifier.train([], [], settings).score(*_bytes("x")) == pytest.approx([0.5])


def _bytes(text):
    import numpy as np

    data = np.frombuffer(text.encode(), np.uint8)
    return data, np.array([0, len(data)])


def test_license_scan(spark, docs, empty):
    model = license_scan.fit(docs)
    texts = spark.createDataFrame([(1, "river stone\nReleased under the MIT License.\nhouse"), (2, "Licensed under the Apache License, Version 2.0"), (3, "This work is licensed under the GNU General Public License, version 3."), (4, "a plain line about a bridge and a river"), (5, None), (6, ""), (7, " ".join(["stone"] * 100) + " Licensed under CC BY-NC 4.0. " + " ".join(["light"] * 100))], "doc_id bigint, text string")
    found = {r["doc_id"]: r["families"] for r in license_scan.scan(texts, model).collect()}
    assert found == {1: ["mit"], 2: ["apache"], 3: ["gpl"], 4: [], 5: [], 6: [], 7: ["cc"]}
    assert license_scan.scan(docs, model).where(F.size("families") > 0).count() == 0
    assert license_scan.scan(empty, license_scan.fit(empty)).count() == 0


def test_bpe_encodes_each_word_once(monkeypatch):
    """A string between white space is encoded once, and only where the tokenizer's description allows it."""
    import json

    from tokenizers import Tokenizer

    library = Tokenizer.from_file(TOKENIZER)
    codes, sent = bpe.ChunkCodes(TOKENIZER), []
    monkeypatch.setattr(codes, "encoded", lambda texts, f=codes.encoded: sent.extend(texts) or f(texts))
    texts = ["der  Don't\tΣΑΣ é́ <|ENDOFTEXT|> x<|endoftext|>y \x1c 1", "Don't der der\r\ń \u0085a b\x0bder", "", " "]
    assert [ids.tolist() for ids in codes.fresh([t.encode() for t in texts])] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert len(sent) == len(set(sent)) == len({w for t in texts for w in t.encode().split()})
    text = json.loads(library.to_str())
    assert bpe._apart_at_space(text)
    text["added_tokens"][0]["lstrip"] = True
    assert not bpe._apart_at_space(text)
    text["added_tokens"] = []
    for pattern in ("[^\\p{L}]+|\\p{L}+", "\\s+|\\p{L}+", "\\p{L}+(?=\\s)", "\\bx| a", "\\p{L}|\\t", "[!-~]+"):
        text["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] = pattern
        assert not bpe._apart_at_space(text)
