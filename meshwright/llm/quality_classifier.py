"""A quality classifier by supervised subword embeddings.

Each word and each run of 3 to 5 characters within a word (its borders included) is
hashed to a row of a table of learned vectors, and a word that repeats the one
before it has a row of its own; a document is the mean of its
vectors, and a softmax over a linear layer gives the class. Training is plain
stochastic gradient descent in numpy on the driver, on a bounded sample of
labelled documents. As mean, linear layer and difference of the two logits are
all linear, scoring needs one number per table row: documents are scored by
table look-ups in one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meshwright.llm.text import CONTINUES, Words, prefix_hash, slices, span_hash

SLICE_BYTES = 500_000
#: The table row of a word that is the word before once more.
AGAIN = 0


@dataclass(frozen=True)
class Settings:
    """fit_docs and fit_bytes bound the sample that the driver trains on; the documents that follow in a random order fill it.

    Training looks at `examples` documents at least, the sample's over and over.
    A vector's share of a document is small; vector_gain is how much faster vectors learn than the layer.
    """

    bits: int = 17
    dims: int = 4
    ngrams: tuple[int, ...] = (3, 4, 5)
    examples: int = 12_000
    rate: float = 1.0
    vector_gain: float = 30.0
    batch: int = 16
    seed: int = 11
    fit_docs: int = 4000
    fit_bytes: int = 12_000_000


def features(data: np.ndarray, offsets: np.ndarray, settings: Settings) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(table rows, position of each text's first) for each kind of feature of the texts of a slice."""
    words = Words(data, offsets)
    plain = np.where(words.space, np.uint8(32), words.data)
    prefix = prefix_hash(plain)
    shift = np.uint64(64 - settings.bits)
    word = span_hash(prefix, words.starts, words.ends)
    yield (word >> shift).astype(np.int64), np.concatenate(([0], np.cumsum(words.counts)))
    again = np.flatnonzero((word[1:] == word[:-1]) & (words.doc[1:] == words.doc[:-1])) + 1
    yield np.full(len(again), AGAIN, np.int64), np.searchsorted(again, np.concatenate(([0], np.cumsum(words.counts))))
    chars = np.flatnonzero(~CONTINUES[plain])  # where characters start
    bounds = np.append(chars, len(plain))
    spaces = np.concatenate(([0], np.cumsum(words.space[chars])))
    for n in settings.ngrams:
        k = np.arange(max(0, len(chars) - n + 1))
        k = k[spaces[k + n - 1] == spaces[k + 1]]  # only the first and the last character may be a border
        rows = (span_hash(prefix, chars[k], bounds[k + n]) >> shift).astype(np.int64)
        yield rows, np.searchsorted(chars[k], np.concatenate((words.first - 1, [len(plain) - 1])))


@dataclass
class Model:
    """The learned vectors, folded: evidence of each table row for label 1, and the bias."""

    evidence: np.ndarray
    bias: float
    settings: Settings

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The probability of label 1 of each text; of a text without features, that of the bias alone."""
        total, count = np.zeros(len(offsets) - 1), np.zeros(len(offsets) - 1, np.int64)
        for rows, bounds in features(data, offsets, self.settings):
            sums = np.concatenate(([0.0], np.cumsum(self.evidence[rows], dtype=np.float64)))
            total += sums[bounds[1:]] - sums[bounds[:-1]]
            count += np.diff(bounds)
        return 1 / (1 + np.exp(-(total / np.maximum(count, 1) + self.bias)))


def _bags(texts: list[str], settings: Settings) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct table rows of each text and their shares of its features."""
    out = []
    for _, _, data, offsets in slices(pa.array(texts, pa.string()), SLICE_BYTES):
        found = list(features(data, offsets, settings))
        for i in range(len(offsets) - 1):
            rows, counts = np.unique(np.concatenate([r[b[i] : b[i + 1]] for r, b in found]), return_counts=True)
            out.append((rows, (counts / max(1, counts.sum())).astype(np.float32)))
    return out


def train(texts: list[str], labels: list[int], settings: Settings = Settings()) -> Model:
    """Fit vectors and softmax layer by stochastic gradient descent with a falling rate.

    Without texts, or with one label only, the model has no evidence and its
    bias is the smoothed share of label 1.
    """
    ones = sum(labels)
    prior = float(np.log((ones + 1) / (len(labels) - ones + 1)))
    random = np.random.default_rng(settings.seed)
    vectors = random.uniform(-1 / settings.dims, 1 / settings.dims, (2**settings.bits, settings.dims)).astype(np.float32)
    layer, bias = np.zeros((settings.dims, 2), np.float32), np.array([-prior / 2, prior / 2], np.float32)
    if 0 < ones < len(labels):
        bags, target = _bags(texts, settings), np.eye(2, dtype=np.float32)[labels]
        epochs = -(-settings.examples // len(bags))
        steps = epochs * len(bags)
        done = 0
        for _ in range(epochs):
            order = random.permutation(len(bags))
            for k in range(0, len(order), settings.batch):
                some = order[k : k + settings.batch]
                rate = settings.rate * (1 - done / steps)
                done += len(some)
                sizes = np.array([len(bags[i][0]) for i in some])
                rows, shares = np.concatenate([bags[i][0] for i in some]), np.concatenate([bags[i][1] for i in some])
                owner = np.repeat(np.arange(len(some)), sizes)
                weighted = vectors[rows] * shares[:, None]
                mean = np.stack([np.bincount(owner, weighted[:, d], len(some)) for d in range(settings.dims)], axis=1).astype(np.float32)
                logits = mean @ layer + bias
                chance = np.exp(logits - logits.max(axis=1, keepdims=True))
                wrong = target[some] - chance / chance.sum(axis=1, keepdims=True)
                toward = wrong @ layer.T
                layer += rate / len(some) * (mean.T @ wrong)
                bias += rate / len(some) * wrong.sum(axis=0)
                np.add.at(vectors, rows, (settings.vector_gain * rate / len(some)) * toward[owner] * shares[:, None])
    across = layer[:, 1] - layer[:, 0]
    return Model((vectors @ across).astype(np.float32), float(bias[1] - bias[0]), settings)


def labelled_sample(docs: DataFrame, labels: DataFrame, settings: Settings, id_col: str, text_col: str, label_col: str) -> list:
    """Up to fit_docs labelled documents within fit_bytes, in the order of a hash of their ids.

    Labels other than 0 and 1, null ones too, and labels of null ids are left
    out. An id with both labels counts as label 1. A null text is left out.
    Empty tables give an empty sample.
    """
    draw = F.xxhash64(F.lit(settings.seed), id_col)
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(id_col).agg(F.max(label_col).alias("__label"))
    chosen = known.orderBy(draw, id_col).limit(settings.fit_docs)
    texts = docs.select(id_col, text_col).join(F.broadcast(chosen), id_col)  # fit_docs rows at most
    texts = texts.where(F.octet_length(text_col) <= settings.fit_bytes).orderBy(draw, id_col, F.xxhash64(text_col)).limit(settings.fit_docs)
    line = W.orderBy(draw, id_col, F.xxhash64(text_col)).rowsBetween(W.unboundedPreceding, 0)
    return texts.withColumn("__sum", F.sum(F.octet_length(text_col)).over(line)).where(F.col("__sum") <= settings.fit_bytes).select(text_col, "__label").collect()


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: id and score (0 to 1, the probability of label 1).

    Null, empty and wordless texts score by the bias. Whole texts are read,
    whatever their length. Ids may be null or repeated; other columns of `docs`
    are not looked at. An empty table gives an empty table.
    """
    source = docs.select(id_col, text_col)
    schema = T.StructType([source.schema[0], T.StructField("score", T.DoubleType())])
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 2**bits numbers

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, offsets in slices(batch.column(1), SLICE_BYTES):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, end - row), pa.array(sent.value.score(data, offsets))], names=schema.names)

    return source.mapInArrow(scored, schema)
