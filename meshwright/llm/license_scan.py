"""Licence notices found by a trained paragraph classifier and confirmed against templates.

Paragraphs (what stands between blank lines, and overlapping windows of long
ones; a single line feed is a space) are bags of hashed
word n-grams; a multinomial logistic regression, trained by numpy stochastic
gradient descent, tells licence families from everything else. Training
paragraphs of the families are drawn from the templates below with cuts,
filler words and changed numbers; those of the unknown class come from a
bounded sample of the documents. The probability from which a family counts is
calibrated on paragraphs of the unknown class that training doesn't see. A
predicted family stands only if the paragraph shares enough word triples with
one of the family's templates; else the paragraph is an unknown licence.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meshwright.llm.text import Words, slices, span_hash

SLICE_BYTES = 500_000

# Wording of public licence notices, by family.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "apache": (
        "licensed under the apache license version 2 0",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind",
    ),
    "bsd": (
        "licensed under the bsd license",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        "released under the bsd 3 clause license",
    ),
    "cc": (
        "licensed under cc by nc 4 0",
        "licensed under cc by sa 4 0",
        "this work is licensed under a creative commons attribution 4 0 international license",
        "licensed under a creative commons attribution noncommercial license",
    ),
    "gpl": (
        "this work is licensed under the gnu general public license version 3",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
        "licensed under the gnu lesser general public license version 2 1",
    ),
    "mit": (
        "released under the mit license",
        "licensed under the mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    ),
    "mpl": (
        "this source code form is subject to the terms of the mozilla public license v 2 0",
        "licensed under the mozilla public license version 2 0",
    ),
}
FAMILIES = ("none", *TEMPLATES)


@dataclass(frozen=True)
class Settings:
    """fit_docs and fit_bytes bound the sample of documents that paragraphs of the unknown class are taken from."""

    bits: int = 16
    ngrams: int = 3
    window: int = 32
    step: int = 16
    fit_docs: int = 400
    fit_bytes: int = 4_000_000
    per_template: int = 120
    epochs: int = 12
    rate: float = 2.0
    batch: int = 32
    seed: int = 5
    #: Share of paragraphs of the unknown class that may pass for a family before templates are compared.
    false_share: float = 0.001
    least_shared: float = 0.6


PLAIN = np.arange(256, dtype=np.uint8)
PLAIN[65:91] += 32
PLAIN[[c for c in range(128) if not chr(c).isalnum()]] = 32
PLAIN[10] = 10


class Paragraphs:
    """Windows of the paragraphs of some texts: `first` and `end` are word numbers.

    A paragraph ends where a line without words follows, or the text ends.
    Marks of comments count as spaces, so that a line of only such is blank.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, settings: Settings):
        self.words = words = Words(PLAIN[data], offsets)
        feeds = np.flatnonzero(words.data == 10)
        before = np.searchsorted(words.starts, feeds)  # words before each line feed
        blank = np.concatenate((before[1:] == before[:-1], [True]))  # no word up to the next line feed
        blank[0] = True
        edges = np.concatenate(([0], words.end))  # those before and after texts
        breaks = feeds[blank | np.isin(feeds, edges)]
        first, end = np.searchsorted(words.starts, breaks[:-1]), np.searchsorted(words.starts, breaks[1:])
        some = end > first
        first, end = first[some], end[some]
        more = np.maximum(0, -(-(end - first - settings.window) // settings.step)) + 1
        line = np.repeat(np.arange(len(first)), more)
        at = np.arange(len(line)) - (np.cumsum(more) - more)[line]
        self.first = first[line] + at * settings.step
        self.end = np.minimum(self.first + settings.window, end[line])
        self.doc = words.doc[self.first] if len(self.first) else self.first
        prefix, shift = words.prefix(), np.uint64(64 - settings.bits)
        self.rows = [(span_hash(prefix, words.starts[: len(words.starts) - n], words.ends[n:]) >> shift).astype(np.int64) for n in range(settings.ngrams)]

    def bag(self, i: int) -> np.ndarray:
        return np.concatenate([rows[self.first[i] : max(self.first[i], self.end[i] - n)] for n, rows in enumerate(self.rows)])

    def logits(self, weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
        total, size = np.zeros((len(self.first), weights.shape[1])), np.zeros(len(self.first))
        for n, rows in enumerate(self.rows):
            sums = np.concatenate((np.zeros((1, weights.shape[1])), np.cumsum(weights[rows], axis=0, dtype=np.float64)))
            end = np.maximum(self.first, self.end - n)
            total += sums[np.minimum(end, len(rows))] - sums[np.minimum(self.first, len(rows))]
            size += end - self.first
        return total / np.sqrt(np.maximum(size, 1))[:, None] + bias

    def text(self, i: int) -> str:
        return bytes(self.words.data[self.words.starts[self.first[i]] : self.words.ends[self.end[i] - 1]]).decode("utf-8", "replace")


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


def _triples(text: str) -> set[tuple[str, ...]]:
    words = re.findall(r"\S+", re.sub(r"\d+", "0", text))
    return {tuple(words[i : i + 3]) for i in range(max(1, len(words) - 2))}


SHINGLES = {family: [_triples(t) for t in texts] for family, texts in TEMPLATES.items()}


def shared(text: str, family: str) -> float:
    """The largest share of a template's word triples that the text has, numbers alike."""
    own = _triples(text)
    return max(len(own & t) / len(t) for t in SHINGLES[family])


@dataclass
class Model:
    weights: np.ndarray
    bias: np.ndarray
    least: float
    settings: Settings

    def find(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, str, float, float]]:
        """(text, family or "unknown", probability, share of the template) of each paragraph that passes for a licence."""
        parts = Paragraphs(data, offsets, self.settings)
        if not len(parts.first):
            return []
        chance = _softmax(parts.logits(self.weights, self.bias))
        best = chance[:, 1:].argmax(axis=1) + 1
        found = []
        for i in np.flatnonzero(chance[np.arange(len(best)), best] >= self.least).tolist():
            family, text = FAMILIES[best[i]], parts.text(i)
            share = shared(text, family)
            found.append((int(parts.doc[i]), family if share >= self.settings.least_shared else "unknown", float(chance[i, best[i]]), share))
        return found


def _variants(settings: Settings, filler: list[str]) -> Iterator[tuple[str, int]]:
    """Training paragraphs of the families: templates with a cut end, filler words around and other numbers."""
    random = np.random.default_rng(settings.seed)
    for label, (_, texts) in enumerate(TEMPLATES.items(), 1):
        for text in texts:
            for _ in range(settings.per_template):
                words = [str(random.integers(1, 10)) if w.isdigit() else w for w in text.split()]
                words = words[: max(5, len(words) - int(random.integers(0, 6)))]
                around = [filler[i] for i in random.integers(0, len(filler), random.integers(0, 12))] if filler else []
                k = int(random.integers(0, len(around) + 1))
                yield " ".join([*around[:k], *words, *around[k:]]), label


def train(sample: list[str], settings: Settings = Settings()) -> Model:
    """Fit the classifier on variants of the templates and on paragraphs of the sample, of which a fifth calibrates."""
    others: list[str] = []
    for _, _, data, offsets in slices(pa.array(sample, pa.string()), SLICE_BYTES):
        parts = Paragraphs(data, offsets, settings)
        others += [parts.text(i) for i in range(len(parts.first))]
    others = [t for t in others if max(shared(t, family) for family in TEMPLATES) < 0.3]
    random = np.random.default_rng(settings.seed)
    filler = [w for t in others[:2000] for w in t.split()]
    others = [others[i] for i in random.permutation(len(others))[:10_000]]
    aside = others[::5]
    examples = [*_variants(settings, filler), *((t, 0) for i, t in enumerate(others) if i % 5)]
    bags = []
    for _, _, data, offsets in slices(pa.array([t for t, _ in examples], pa.string()), SLICE_BYTES):
        whole = Paragraphs(data, offsets, Settings(**{**settings.__dict__, "window": 1 << 30}))
        at = dict(zip(whole.doc.tolist(), range(len(whole.first)), strict=True))
        bags += [whole.bag(at[i]) if i in at else np.zeros(0, np.int64) for i in range(len(offsets) - 1)]
    target = np.eye(len(FAMILIES))[[label for _, label in examples]]
    weights, bias = np.zeros((2**settings.bits, len(FAMILIES)), np.float32), np.zeros(len(FAMILIES))
    steps, done = settings.epochs * len(bags), 0
    for _ in range(settings.epochs):
        order = random.permutation(len(bags))
        for k in range(0, len(order), settings.batch):
            some = order[k : k + settings.batch]
            rate, done = settings.rate * (1 - done / steps) / len(some), done + len(some)
            sizes = np.array([len(bags[i]) for i in some])
            rows, owner = np.concatenate([bags[i] for i in some]), np.repeat(np.arange(len(some)), sizes)
            scale = 1 / np.sqrt(np.maximum(sizes, 1))
            logits = np.stack([np.bincount(owner, c, len(some)) for c in weights[rows].T], axis=1) * scale[:, None] + bias
            wrong = target[some] - _softmax(logits)
            np.add.at(weights, rows, (rate * wrong * scale[:, None])[owner].astype(np.float32))
            bias += rate * wrong.sum(axis=0)
    model = Model(weights, bias, 0.5, settings)
    if aside:
        data = "\n\n".join(aside).encode()
        passed = _softmax(Paragraphs(np.frombuffer(data, np.uint8), np.array([0, len(data)]), settings).logits(weights, bias))[:, 1:].max(axis=1)
        model.least = float(min(0.95, max(0.5, np.quantile(passed, 1 - settings.false_share))))
    return model


def fit(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model whose unknown class is drawn from up to fit_docs documents of fit_bytes / fit_docs bytes at most, in the order of a hash.

    Null texts aren't drawn; without documents the unknown class has no examples.
    """
    marked = docs.where(F.octet_length(text_col) <= settings.fit_bytes // settings.fit_docs).select(F.xxhash64(F.lit(settings.seed), id_col, text_col).alias("draw"), F.col(text_col).alias("text"))
    chosen = marked.select("draw").distinct().orderBy("draw").limit(settings.fit_docs)
    some = marked.join(F.broadcast(chosen), "draw").dropDuplicates(["draw"])  # fit_docs rows at most
    return train([r["text"] for r in some.orderBy("draw").select("text").collect()], settings)


def scan(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: id, families (confirmed ones in order, each once), n_paragraphs (confirmed), n_unknown, best probability.

    Windows of a long paragraph overlap, so a notice may count twice in
    n_paragraphs. Null, empty and wordless texts have none: an empty array, 0,
    0 and null. Whole texts are scanned. Ids may be null or repeated. An empty
    table gives an empty table.
    """
    source = docs.select(id_col, text_col)
    schema = T.StructType([source.schema[0], T.StructField("families", T.ArrayType(T.StringType())), T.StructField("n_paragraphs", T.LongType()), T.StructField("n_unknown", T.LongType()), T.StructField("probability", T.DoubleType())])
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 2**bits rows of weights

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, offsets in slices(batch.column(1), SLICE_BYTES):
                n = end - row
                families, counts, unknown, best = [set() for _ in range(n)], [0] * n, [0] * n, [None] * n
                for doc, family, chance, _ in sent.value.find(data, offsets):
                    if family == "unknown":
                        unknown[doc] += 1
                        continue
                    families[doc].add(family)
                    counts[doc] += 1
                    best[doc] = max(best[doc] or 0.0, chance)
                columns = [pa.array([sorted(f) for f in families], pa.list_(pa.string())), pa.array(counts, pa.int64()), pa.array(unknown, pa.int64()), pa.array(best, pa.float64())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, n), *columns], names=schema.names)

    return source.mapInArrow(scanned, schema)
