"""A bigram language model with Katz backoff, trained and evaluated without gathering it in one place.

Counts are Good-Turing discounted; what the discounts free is given to words
not seen after a history, in proportion to their unigram probability, by
backoff weights that make every distribution sum to one. The unigram level
backs off to a single unknown word in the same way. A token is evaluated
recursively: bigram, else backoff weight times unigram, else unknown word.

Documents are tokenised into blocks of some million tokens. A block sends its
distinct words, and later its distinct bigrams, to the partition that owns the
word or the history; the partition merges the counts of all blocks into its
part of the count tables and answers each block with the counts it asked for.
So a frequent word is an entry per block, not one per occurrence. A history
with more than a part's share of all tokens has its pairs spread over parts by
word, in proportion to its share. Rows hold compressed arrays.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from meshwright.llm.storage import cut, drop, release, store
from meshwright.llm.text import Words, slices, span_hash, tidy, tidy_group

SLICE_BYTES = 1_000_000
#: Tokens of a block, but for a longer text; counts up to CUT are discounted; bytes of text for each part of the vocabulary.
BLOCK_TOKENS, CUT, PART_BYTES = 2_000_000, 5, 16_000_000
END = np.uint64(1)  # the hash that stands for the end of a text
UNKNOWN, START = np.uint32(0xFFFFFFFF), np.uint32(0xFFFFFFFE)  # places in a part of the vocabulary
ROW = "block long, part int, data binary"


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed value; the bytes of equal weight of an array's numbers stand together."""
    planes = [(a.dtype.str, np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T).tobytes()) for a in arrays]
    return zstandard.ZstdCompressor(level=3).compress(pickle.dumps(planes))


def unpack(data: bytes) -> list[np.ndarray]:
    planes = pickle.loads(zstandard.ZstdDecompressor().decompress(data))
    return [np.array(np.frombuffer(b, np.uint8).reshape(np.dtype(t).itemsize, -1).T, order="C").view(t).ravel() for t, b in planes]


def _small(a: np.ndarray) -> np.ndarray:
    return a.astype(np.uint32) if not len(a) or a.max() < 2**32 else a.astype(np.uint64)


@dataclass
class Discounts:
    """Good-Turing discount factors for counts of 1 to CUT, from the number of items by count.

    Where Katz's formula gives a factor outside (0, 1], as on small corpora,
    that of absolute discounting takes its place.
    """

    items: list[int]  # items[r]: how many occur r times, for r up to CUT + 1
    factor: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        n = self.items
        self.factor = np.ones(CUT + 2)
        if n[1] == 0:
            return
        common = (CUT + 1) * n[CUT + 1] / n[1]
        taken = n[1] / (n[1] + 2 * n[2])
        for r in range(1, CUT + 1):
            katz = ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common) if n[r] and common < 1 else 0.0
            self.factor[r] = katz if 0 < katz <= 1 else (r - min(taken, 0.9)) / r

    def of(self, counts: np.ndarray) -> np.ndarray:
        return np.where(counts <= CUT, self.factor[np.minimum(counts, CUT).astype(np.int64)], 1.0)

    def freed(self, by_count: np.ndarray) -> np.ndarray:
        """What the discounts free, in counts, given how many items occur 1 to CUT times (last axis)."""
        r = np.arange(1, CUT + 1)
        return (by_count * (r * (1 - self.factor[1 : CUT + 1]))).sum(axis=-1)


@dataclass
class Unigrams:
    """The unigram level: probabilities from counts, and that of the unknown word."""

    tokens: int
    distinct: int
    discounts: Discounts

    def __post_init__(self) -> None:
        freed = float(self.discounts.freed(np.array(self.discounts.items[1 : CUT + 1])))
        self.total = self.tokens if freed > 0 else self.tokens + 1
        self.unknown = (freed if freed > 0 else 1.0) / self.total

    def chance(self, counts: np.ndarray) -> np.ndarray:
        return np.where(counts > 0, self.discounts.of(counts) * counts / self.total, self.unknown)


def backoff(total: np.ndarray, by_count: np.ndarray, seen: np.ndarray, discounts: Discounts) -> tuple[np.ndarray, np.ndarray]:
    """(divisor of counts, backoff weight) of histories, given their total counts, items by count, and the unigram chance of words seen after them.

    A history whose counts free nothing has its divisor raised by one.
    """
    freed = discounts.freed(by_count)
    divisor = np.where(freed > 0, total, total + 1).astype(np.float64)
    return divisor, np.where(freed > 0, freed, 1.0) / divisor / (1 - seen)


def part_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    """Parts by ranges of hashes, so that sorted hashes have sorted parts."""
    return ((hashes >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _token_blocks(parts: int):
    """(id, train, text) to rows of part -1 (a block's token numbers, sizes, train flags and ids) and of each part (its distinct words and train counts)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, held, size = TaskContext.get().partitionId() << 24, [], 0

        def block() -> pa.RecordBatch:
            nonlocal made
            made += 1
            tokens, sizes, train = (np.concatenate([x[i] for x in held]) for i in range(3))
            ids = [i for x in held for i in x[3]]
            words, number = np.unique(tokens, return_inverse=True)
            counts = np.bincount(number[np.repeat(train, sizes)], minlength=len(words))
            bounds = np.searchsorted(part_of(words, parts), np.arange(parts + 1))
            found = [(-1, pickle.dumps((ids, pack(_small(number), _small(sizes), train.astype(np.uint8)))))]
            found += [(p, pack(words[a:b], _small(counts[a:b]))) for p, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)) if b > a]
            return pa.RecordBatch.from_arrays([pa.array([made] * len(found), pa.int64()), pa.array([p for p, _ in found], pa.int32()), pa.array([d for _, d in found], pa.binary())], names=["block", "part", "data"])

        for batch in batches:
            for row, end, data, offsets in slices(batch.column(2), SLICE_BYTES):
                words = Words(data, offsets, lower=True)
                hashes = span_hash(words.prefix(), words.starts, words.ends)
                hashes[hashes == END] += np.uint64(1)
                tokens = np.insert(hashes, np.cumsum(words.counts), END)
                train = batch.column(1).slice(row, end - row).fill_null(False).to_numpy(zero_copy_only=False)
                held.append((tokens, words.counts + 1, train, batch.column(0).slice(row, end - row).to_pylist()))
                size += len(tokens)
                if size >= BLOCK_TOKENS:
                    yield block()
                    held, size = [], 0
        if held:
            yield block()

    return rows


STATS = ", ".join(["tokens long", "distinct_ long", *(f"n{r} long" for r in range(1, CUT + 2))])


def _answer(blocks: list[int], part: int, answers: list[bytes], model: bytes, tokens: int, distinct: int, by_count: np.ndarray) -> pa.Table:
    """A part's answers to blocks, and one more row (block null) of its count table and statistics."""
    n = len(blocks)
    stats = [tokens, distinct, *by_count[1:].tolist()]
    names = ["block", "part", "data", "tokens", "distinct_", *(f"n{r}" for r in range(1, CUT + 2))]
    return pa.table([pa.array([*blocks, None], pa.int64()), pa.array([part] * (n + 1), pa.int32()), pa.array([*answers, model], pa.binary()), *(pa.array([None] * n + [x], pa.int64()) for x in stats)], names=names)


def _merge_words(table: pa.Table) -> pa.Table:
    """The blocks' words of one part: (count, place in the part) for each word asked."""
    asked = [unpack(x.as_py()) for x in table["data"]]
    sizes = [len(words) for words, _ in asked]
    words, number = np.unique(np.concatenate([w for w, _ in asked]), return_inverse=True)
    counts = np.zeros(len(words), np.int64)
    np.add.at(counts, number, np.concatenate([c for _, c in asked]).astype(np.int64))
    place = np.where(counts > 0, np.cumsum(counts > 0) - 1, int(UNKNOWN)).astype(np.uint32)
    answers = [pack(_small(counts[own]), place[own]) for own in np.split(number, np.cumsum(sizes)[:-1])]
    by_count = np.bincount(counts[(counts > 0) & (counts <= CUT + 1)], minlength=CUT + 2)
    return _answer(table["block"].to_pylist(), table["part"][0].as_py(), answers, pack(words[counts > 0], _small(counts[counts > 0])), int(counts.sum()), int((counts > 0).sum()), by_count)


@dataclass
class Block:
    """A block's tokens with what is known of its words, and its distinct bigrams."""

    ids: list
    numbers: np.ndarray  # of tokens
    sizes: np.ndarray
    train: np.ndarray
    counts: np.ndarray  # of words, in the training tokens
    part: np.ndarray
    place: np.ndarray
    end: int  # which word is the end of a text

    @classmethod
    def of(cls, text: bytes, answers: list[tuple[int, bytes]]) -> Block:
        ids, data = pickle.loads(text)
        numbers, sizes, train = unpack(data)
        known = [(p, *unpack(d)) for p, d in sorted(answers)]
        part = np.concatenate([np.full(len(c), p) for p, c, _ in known])
        return cls(ids, numbers.astype(np.int64), sizes.astype(np.int64), train.astype(bool), np.concatenate([c.astype(np.int64) for _, c, _ in known]), part, np.concatenate([x for _, _, x in known]), int(numbers[sizes.astype(np.int64)[0] - 1]))

    def bigrams(self, parts: int, tokens: int) -> None:
        """Distinct (history, word) pairs in order, start of text as the last history; `which` tells each token's pair."""
        n = len(self.counts)
        history = np.empty_like(self.numbers)
        history[1:] = self.numbers[:-1]
        history[np.cumsum(self.sizes) - self.sizes] = n
        pairs, self.which = np.unique(history * (n + 1) + self.numbers, return_inverse=True)
        self.pair_history, self.pair_word = pairs // (n + 1), pairs % (n + 1)
        self.histories, self.pair_at = np.unique(self.pair_history, return_inverse=True)
        # of histories: the part that owns them, whether they are in its vocabulary, and over how many parts their pairs are spread
        home = np.append(self.part, 0)[self.histories]
        place = np.append(self.place, START)[self.histories]
        self.history_id = home.astype(np.uint64) << np.uint64(32) | place.astype(np.uint64)
        asked = place != UNKNOWN
        spread = np.append(self.counts, self.counts[self.end])[self.histories] * parts // max(1, tokens) + 1
        self.hot = spread > 1
        self.history_part = np.where(asked, home, -1)
        word = self.part[self.pair_word] + self.place[self.pair_word].astype(np.int64) * 7919
        pair_part = (home[self.pair_at] + word % spread[self.pair_at]) % parts
        self.pair_part = np.where(asked[self.pair_at] & (self.counts[self.pair_word] > 0), pair_part, -1)

    def questions(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(part, histories asked of it, their pairs in the order of histories), depending on the block alone.

        A history belongs to one part, but for those with more than a part's
        share of all tokens: their pairs are spread over parts by word.
        """
        order = np.lexsort((np.arange(len(self.pair_part)), self.pair_part))
        cold = np.where(self.hot, -1, self.history_part)
        for p in np.unique(np.concatenate((self.pair_part, cold))):
            if p < 0:
                continue
            c, d = np.searchsorted(self.pair_part[order], [p, p + 1])
            pairs = order[c:d]
            yield int(p), np.union1d(np.flatnonzero(cold == p), self.pair_at[pairs]), pairs


def _open(table: pa.Table, parts: int, tokens: int) -> tuple[Block, list[tuple[int, bytes]]]:
    """The block of a group of rows (kind 0: text, 1: words, 2: bigrams), and the answers on its bigrams."""
    rows = list(zip(table["kind"].to_pylist(), table["part"].to_pylist(), table["data"].to_pylist(), strict=True))
    block = Block.of(next(d for k, _, d in rows if k == 0), [(p, d) for k, p, d in rows if k == 1])
    block.bigrams(parts, tokens)
    return block, [(p, d) for k, p, d in rows if k == 2]


def _ask_bigrams(parts: int, tokens: int):
    def asked(table: pa.Table) -> pa.Table:
        block, _ = _open(table, parts, tokens)
        trained = np.bincount(block.which, np.repeat(block.train, block.sizes), len(block.pair_at)).astype(np.int64)
        found = []
        for part, histories, pairs in block.questions():
            per_history = np.bincount(np.searchsorted(histories, block.pair_at[pairs]), minlength=len(histories))
            words = block.pair_word[pairs]
            found.append((part, pack(block.history_id[histories], block.hot[histories].astype(np.uint8), _small(per_history), block.part[words].astype(np.uint32), block.place[words], _small(trained[pairs]), _small(block.counts[words]))))
        return pa.table([pa.array([table["block"][0].as_py()] * len(found), pa.int64()), pa.array([p for p, _ in found], pa.int32()), pa.array([d for _, d in found], pa.binary())], names=["block", "part", "data"])

    return asked


def _merge_bigrams(unigrams: Unigrams):
    def merged(table: pa.Table) -> pa.Table:
        """Of one part of the histories: counts of the pairs asked, and of the histories total, items by count and the unigram chance of words seen."""
        asked = [unpack(x.as_py()) for x in table["data"]]
        places, at, which_history = np.unique(np.concatenate([a[0] for a in asked]), return_index=True, return_inverse=True)
        hot = np.concatenate([a[1] for a in asked])[at] > 0
        history = np.repeat(which_history, np.concatenate([a[2] for a in asked]).astype(np.int64))
        word = np.concatenate([a[3].astype(np.uint64) << np.uint64(32) | a[4].astype(np.uint64) for a in asked])
        words, which_word = np.unique(word, return_inverse=True)
        pairs, first, number = np.unique(history * max(1, len(words)) + which_word, return_index=True, return_inverse=True)
        counts = np.zeros(len(pairs), np.int64)
        np.add.at(counts, number, np.concatenate([a[5] for a in asked]).astype(np.int64))
        owner = history[first]
        total = np.bincount(owner, counts, len(places)).astype(np.int64)
        chance = unigrams.chance(np.concatenate([a[6] for a in asked]).astype(np.int64)[first])
        seen = np.bincount(owner, chance * (counts > 0), len(places))
        by_count = np.zeros((len(places), CUT), np.int64)
        few = (counts > 0) & (counts <= CUT)
        np.add.at(by_count, (owner[few], counts[few] - 1), 1)
        heads = np.cumsum([len(a[0]) for a in asked])[:-1]
        tails = np.cumsum([len(a[3]) for a in asked])[:-1]
        answers = [pack(_small(total[h]), *(_small(by_count[h, r]) for r in range(CUT)), seen[h], _small(counts[p])) for h, p in zip(np.split(which_history, heads), np.split(number, tails), strict=True)]
        kept = counts > 0
        model = pack(places[owner[kept]], words[which_word[first[kept]]] if len(words) else words, _small(counts[kept]))
        items = np.bincount(counts[kept & (counts <= CUT + 1)], minlength=CUT + 2)
        answer = _answer(table["block"].to_pylist(), table["part"][0].as_py(), answers, model, int(counts.sum()), int(kept.sum()), items)
        return answer.append_column("spread", pa.array([None] * len(answers) + [pack(places[hot], total[hot], by_count[hot].ravel(), seen[hot])], pa.binary()))

    return merged


def _spread_histories(rows: list[bytes]) -> tuple[np.ndarray, ...]:
    """Sums over parts of the figures of histories that are spread over them: id, total, items by count, chance seen.

    They are at most as many as there are parts, and so are the parts of each
    in proportion to its share: 2 * parts rows in all.
    """
    found = [unpack(x) for x in rows]
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0), np.zeros((0, CUT)), np.zeros(0)
    ids, number = np.unique(np.concatenate([f[0] for f in found]), return_inverse=True)
    total, by_count, seen = np.zeros(len(ids)), np.zeros((len(ids), CUT)), np.zeros(len(ids))
    np.add.at(total, number, np.concatenate([f[1] for f in found]))
    np.add.at(by_count, number, np.concatenate([f[2] for f in found]).reshape(-1, CUT))
    np.add.at(seen, number, np.concatenate([f[3] for f in found]))
    return ids, total, by_count, seen


def _evaluate(unigrams: Unigrams, discounts: Discounts, spread: tuple[np.ndarray, ...], parts: int, names: list[str], id_type: pa.DataType):
    def scored(table: pa.Table) -> pa.Table:
        block, answers = _open(table, parts, unigrams.tokens)
        answered = dict(answers)
        lower = unigrams.chance(block.counts)[block.pair_word]  # of each pair, by its word alone
        weight, own = np.ones(len(block.histories)), np.zeros(len(lower))
        k = np.minimum(np.searchsorted(spread[0], block.history_id), max(0, len(spread[0]) - 1))
        there = np.flatnonzero(block.hot & (spread[0][k] == block.history_id)) if len(spread[0]) else np.zeros(0, np.int64)
        weight[there] = backoff(spread[1][k[there]], spread[2][k[there]], spread[3][k[there]], discounts)[1]
        for part, histories, pairs in block.questions():
            total, *by_count, seen, counts = unpack(answered[part])
            total, by_count = total.astype(np.float64), np.stack(by_count, axis=1).astype(np.float64)
            hot = np.flatnonzero(block.hot[histories])
            k = np.searchsorted(spread[0], block.history_id[histories[hot]])
            total[hot], by_count[hot], seen[hot] = spread[1][k], spread[2][k], spread[3][k]
            some = total > 0
            divisor, off = backoff(total, by_count, np.where(some, seen, 0.0), discounts)
            weight[histories] = np.where(some, off, 1.0)
            at = np.searchsorted(histories, block.pair_at[pairs])
            known = counts > 0
            own[pairs[known]] = (discounts.of(counts) * counts / divisor[at])[known]
        chance = np.where(own > 0, own, weight[block.pair_at] * lower)
        doc = np.repeat(np.arange(len(block.sizes)), block.sizes)
        base = np.log10((block.counts + 0.5) / (unigrams.tokens + 0.5 * (unigrams.distinct + 1)))  # of each word
        n = len(block.sizes)
        columns = [block.sizes, np.bincount(doc, (block.counts > 0)[block.numbers], n).astype(np.int64), np.full(n, unigrams.tokens), np.bincount(doc, base[block.numbers], n), np.bincount(doc, np.log10(chance)[block.which], n)]
        return pa.table([pa.array(block.ids, id_type), pa.array(block.train), *map(pa.array, columns)], names=names)

    return scored


def _statistics(answers: DataFrame) -> tuple[int, int, list[int]]:
    row = answers.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("tokens", "distinct_", *(f"n{r}" for r in range(1, CUT + 2))))).first()
    return row[0], row[1], [0, *row[2:]]


def score_texts(docs: DataFrame, train: str, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """One row per row of `docs`: id, train, n_tokens, n_known, train_tokens, base_score, score (log10).

    train names a boolean column: the model learns from rows where it is true,
    and scores all. Texts are lower-cased (A-Z); their tokens are their words
    and one end. A null, empty or wordless text is an end alone. Without
    training rows every token is the unknown word, at chance 1. Ids may be
    null or repeated. An empty table gives an empty table. parts: of the
    vocabulary; by default as many as shuffle partitions.
    """
    spark = docs.sparkSession
    parts = min(65_536, parts or int(spark.conf.get("spark.sql.shuffle.partitions")))
    source = docs.select(F.col(id_col).alias("id"), F.col(train).alias("train"), F.col(text_col).alias("text"))
    id_field = docs.schema[id_col]
    schema = T.StructType([T.StructField("id", id_field.dataType), T.StructField("train", T.BooleanType()), *(T.StructField(c, T.LongType()) for c in ("n_tokens", "n_known", "train_tokens")), *(T.StructField(c, T.DoubleType()) for c in ("base_score", "score"))])
    path = store(source.mapInArrow(tidy(_token_blocks(parts)), ROW))
    blocks = spark.read.parquet(path)
    words_path = store(blocks.where("part >= 0").groupBy("part").applyInArrow(tidy_group(_merge_words), f"{ROW}, {STATS}"))
    words = spark.read.parquet(words_path)
    tokens, distinct, items = _statistics(words)
    unigrams = Unigrams(tokens, distinct, Discounts(items))
    release(spark)
    texts = blocks.where("part < 0").select("block", "part", "data", F.lit(0).alias("kind"))
    texts = texts.union(words.where("block is not null").select("block", "part", "data", F.lit(1).alias("kind")))
    bigrams_path = store(texts.groupBy("block").applyInArrow(tidy_group(_ask_bigrams(parts, tokens)), ROW).groupBy("part").applyInArrow(tidy_group(_merge_bigrams(unigrams)), f"{ROW}, {STATS}, spread binary"))
    bigrams = spark.read.parquet(bigrams_path)
    discounts = Discounts(_statistics(bigrams)[2])
    spread = _spread_histories([r[0] for r in bigrams.where("block is null").select("spread").collect()])
    release(spark)
    every = texts.union(bigrams.where("block is not null").select("block", "part", "data", F.lit(2).alias("kind")))
    found = cut(every.groupBy("block").applyInArrow(tidy_group(_evaluate(unigrams, discounts, spread, parts, schema.names, to_arrow_type(id_field.dataType))), schema))
    for each in (path, words_path, bigrams_path):
        drop(spark, each)
    return found
