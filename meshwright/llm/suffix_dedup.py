"""Removal of long byte strings that occur more than once, by sorting suffixes deep-shallow.

A window is a byte string of the given length (400). The least hash among the
seeds (strings of a third of that length, 128 bytes at most) of a window is its anchor; it depends on the window's
bytes alone, so equal windows have equal anchors at the same place in them.
Each anchor owns the consecutive windows it is the least of; the bytes of
these are its context. Only contexts whose anchor occurs elsewhere go on:

1. equal contexts, found by hash, repeat as a whole;
2. the differing contexts of an anchor meet in one task: the suffixes that
   start at the anchor, and the reversed prefixes that end before it, are
   sorted deep-shallow, and the common prefixes of neighbours in both orders
   tell exactly which windows are equal;
3. an anchor with more differing contexts than one task should hold
   (GROUP_MOST) has each window counted on its own instead.

The windows of a context start less than their length apart, so the first and
the last one that repeats bound what is removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meshwright.llm.storage import cut, drop, numbered, release, store
from meshwright.llm.suffix_sort import deep_shallow_sort
from meshwright.llm.text import MIX, binary, mixed, prefix_hash, repeats, slices, span_hash, tidy

SLICE_BYTES = 500_000
#: Contexts of whole groups that are sorted at a time, and the largest group that is.
SORT_AT_ONCE, GROUP_MOST = 8_000, 50_000
LOW = np.uint64(0xFFFFFFFF)


def seed_of(length: int) -> int:
    """Bytes of an anchor."""
    return max(1, min(128, length // 3))


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` consecutive values, by running minima from both ends of blocks."""
    out = len(values) - width + 1
    blocks = np.concatenate([values, np.full(-len(values) % width, np.iinfo(values.dtype).max, values.dtype)]).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:out], ahead[width - 1 : width - 1 + out])


def anchors(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """For each anchor: text, hash, hash of its context, first and last window start and the anchor's place in the text."""
    n, seed = len(data), seed_of(length)
    if n < length:
        return tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.uint64, np.int64, np.int64, np.int64))
    prefix = prefix_hash(data)
    at = np.arange(n - seed + 1)
    hashes = span_hash(prefix, at, at + seed)
    least = _sliding_min((hashes & ~LOW) | at.astype(np.uint64), length - seed + 1)
    end = np.repeat(offsets[1:], np.diff(offsets))
    start = np.flatnonzero(np.arange(len(least)) + length <= end[: len(least)])
    anchor = (least[start] & LOW).astype(np.int64)
    new = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1]))) if len(anchor) else np.zeros(0, np.int64)
    first, last = start[new], start[np.concatenate((new[1:], [len(start)]))[: len(new)] - 1]
    anchor = anchor[new]
    context = mixed(span_hash(prefix, first, last + length) ^ ((anchor - first).astype(np.uint64) * MIX))
    doc = np.searchsorted(offsets, first, "right") - 1
    base = offsets[doc]
    return doc, hashes[anchor], context, first - base, last - base, anchor - base


def _anchor_rows(length: int):
    names = ["h", "c", "tk", "pos"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # equal texts of a task are looked at once
        for batch in batches:
            keys = batch.column(0).to_numpy()
            new = [k not in seen and not seen.add(k) for k in keys.tolist()]
            keys, texts = keys[new], binary(batch.column(1)).filter(pa.array(new))
            for row, _, data, offsets in slices(texts, SLICE_BYTES):
                for part in range(0, max(1, len(data) if len(offsets) == 2 else 1), SLICE_BYTES):  # of a very long text
                    piece = data[part : part + SLICE_BYTES + length - 1] if len(offsets) == 2 else data
                    doc, h, c, first, last, anchor = anchors(piece, np.array([0, len(piece)]) if len(offsets) == 2 else offsets, length)
                    pos = (first + part) << 32 | (last - first) << 16 | (anchor - first)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h.view(np.int64), c.view(np.int64), keys[row + doc], pos)], names=names)

    return tidy(rows)


def _context_rows(length: int):
    """From (text, wanted structs of h, tk, pos, twice): the anchor's context, before it reversed and after it."""
    names = ["h", "tk", "pos", "twice", "before", "after"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, wanted = binary(batch.column(0)), batch.column(1)
            for i in range(batch.num_rows):
                text, own = texts[i].as_py(), wanted[i].values
                befores, afters = [], []
                for pos in own.field("pos").to_pylist():
                    first, anchor = pos >> 32, (pos >> 32) + (pos & 0xFFFF)
                    befores.append(text[first:anchor][::-1])
                    afters.append(text[anchor : first + (pos >> 16 & 0xFFFF) + length])
                yield pa.RecordBatch.from_arrays([own.field("h"), own.field("tk"), own.field("pos"), own.field("twice"), pa.array(befores, pa.binary()), pa.array(afters, pa.binary())], names=names)

    return tidy(rows)


def repeated_windows(group: np.ndarray, pos: np.ndarray, before: list[bytes], after: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each context the fewest and the most bytes before its anchor at which a window starts that another context has too; -1 if none."""
    n, span = len(group), length - seed_of(length)
    right, right_common = deep_shallow_sort(group, after, length)
    left, left_common = deep_shallow_sort(group, before, span)
    right_rank, left_rank = np.empty(n, np.int64), np.empty(n, np.int64)
    right_rank[right], left_rank[left] = np.arange(n), np.arange(n)
    most = pos & 0xFFFF
    least = most - (pos >> 16 & 0xFFFF)
    low, high = np.full(n, -1), np.full(n, -1)
    for ahead in range(span + 1):
        own = np.flatnonzero((least <= ahead) & (ahead <= most))
        if len(own) < 2:
            continue
        right_class = np.cumsum(right_common < length - ahead)[right_rank[own]]
        left_class = np.cumsum(left_common < ahead)[left_rank[own]]
        twice, _ = repeats(right_class * n + left_class)
        own = own[twice]
        low[own[low[own] < 0]] = ahead
        high[own] = ahead
    return low, high


def _resolved_rows(length: int):
    """Contexts in order of their anchor's hash: what is removed of each that isn't repeated as a whole."""

    def solved(rows: pa.Table) -> pa.RecordBatch:
        pos, twice = rows["pos"].to_numpy(), rows["twice"].to_numpy()
        low, high = repeated_windows(rows["h"].to_numpy(), pos, rows["before"].to_pylist(), rows["after"].to_pylist(), length)
        some = (high >= 0) & ~twice
        anchor = (pos[some] >> 32) + (pos[some] & 0xFFFF)
        return pa.RecordBatch.from_arrays([pa.array(rows["tk"].to_numpy()[some]), pa.array(anchor - high[some]), pa.array(anchor - low[some] + length)], names=["tk", "first", "end"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            for k in range(0, batch.num_rows, SORT_AT_ONCE):
                held.append(batch.slice(k, SORT_AT_ONCE))
                if sum(x.num_rows for x in held) < SORT_AT_ONCE:
                    continue
                table = pa.Table.from_batches(held)
                h = table["h"].to_numpy()
                whole = int(np.searchsorted(h, h[-1]))  # the last group may go on
                if whole:
                    yield solved(table.slice(0, whole))
                held = table.slice(whole).combine_chunks().to_batches()
        if held:
            yield solved(pa.Table.from_batches(held))

    return tidy(rows)


def _window_rows(length: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, tk, pos = (batch.column(i).to_numpy() for i in range(3))
            for i, (before, after) in enumerate(zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)):
                data = np.frombuffer(before[::-1] + after, np.uint8)
                start = np.arange(len(data) - length + 1)
                key = mixed(span_hash(prefix_hash(data), start, start + length) ^ (h[i : i + 1].view(np.uint64) * MIX))
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.full(len(start), tk[i])), pa.array(start + (pos[i] >> 32))], names=["key", "tk", "start"])

    return tidy(rows)


def _crowded(contexts: DataFrame, length: int) -> DataFrame:
    windows = cut(contexts.mapInArrow(_window_rows(length), "key long, tk long, start long"))
    many = windows.groupBy("key").agg(F.min("tk").alias("a"), F.max("tk").alias("b"), F.min("start").alias("s"), F.max("start").alias("e")).where("a < b or s < e")
    return windows.join(many.select("key"), "key", "left_semi").select("tk", F.col("start").alias("first"), (F.col("start") + length).alias("end"))


def repeated_spans(docs: DataFrame, text_col: str = "text", length: int = 400, group_most: int = GROUP_MOST) -> tuple[DataFrame, DataFrame]:
    """(row, first, end) of spans to remove from texts that occur once, which may overlap; and (text key, row, copies) of all texts.

    The text key is a 64-bit hash; row is the __row, which `docs` must have, of
    one such text. Texts shorter than `length` bytes have no spans. Texts that
    occur more than once repeat as a whole and have no spans of their own.
    """
    spark = docs.sparkSession
    texts = docs.select(F.xxhash64(text_col).alias("tk"), F.col(text_col).alias("text"))
    keyed = docs.select(F.col("__row").alias("row"), F.xxhash64(text_col).alias("tk"))
    known = cut(keyed.groupBy("tk").agg(F.min("row").alias("row"), F.count("*").alias("copies")))
    path = store(texts.where(F.octet_length("text") >= length).mapInArrow(_anchor_rows(length), "h long, c long, tk long, pos long"))
    found = spark.read.parquet(path)
    differ = "a < b or s < e"
    ends = [F.min("tk").alias("a"), F.max("tk").alias("b"), F.min("pos").alias("s"), F.max("pos").alias("e")]
    shared = cut(found.groupBy("h").agg(*ends).where(differ).select("h"))
    found = cut(found.join(shared, "h", "left_semi"))
    drop(spark, path)
    contexts = cut(found.groupBy("h", "c").agg(*ends, F.min_by("pos", "tk").alias("pos")).select("h", "c", F.col("a").alias("tk"), "pos", F.expr(differ).alias("twice")))
    whole = contexts.where("twice").select("h", "c")
    spans = cut(found.join(whole, ["h", "c"], "left_semi").selectExpr("tk", "shiftright(pos, 32) as first", f"shiftright(pos, 32) + (shiftright(pos, 16) & 65535) + {length} as end"))
    release(spark)
    groups = cut(contexts.groupBy("h").agg(F.count("*").alias("n"), F.bool_and("twice").alias("done")).where("n > 1 and not done").select("h", "n"))
    open_ = contexts.join(groups, "h").join(known.select("tk", "row"), "tk")
    wanted = open_.groupBy("row").agg(F.collect_list(F.struct("h", "tk", "pos", "twice", "n")).alias("wanted"))
    placed = docs.select(F.col("__row").alias("row"), F.col(text_col).alias("text")).join(wanted, "row")
    out_schema = "h long, tk long, pos long, twice boolean, before binary, after binary"

    def part(condition: str) -> DataFrame:
        return placed.select("text", F.filter("wanted", lambda x: (x["n"] <= group_most) if condition == "few" else (x["n"] > group_most)).alias("wanted")).where(F.size("wanted") > 0).mapInArrow(_context_rows(length), out_schema)

    solved = cut(part("few").repartition("h").sortWithinPartitions("h").mapInArrow(_resolved_rows(length), "tk long, first long, end long"))
    spans = spans.union(solved)
    if not groups.where(F.col("n") > group_most).isEmpty():
        spans = spans.union(cut(_crowded(part("many"), length)))
    release(spark)
    return spans.join(known.where("copies = 1"), "tk").select("row", "first", "end"), known


def _merged(firsts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(zip(firsts.tolist(), ends.tolist(), strict=True)):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _with_spans(docs: DataFrame, text_col: str, length: int) -> DataFrame:
    """`docs` with __whole (the text repeats as a whole) and __spans (to remove otherwise), joined by the numbers of rows written once."""
    columns, docs = docs.columns, numbered(docs)
    spans, known = repeated_spans(docs, text_col, length)
    some = spans.groupBy("row").agg(F.collect_list(F.struct("first", "end")).alias("__spans")).select(F.col("row").alias("__row"), "__spans", F.lit(False).alias("__whole"))
    long_texts = docs.select("__row", F.col(text_col).alias("text")).where(F.octet_length("text") >= length)
    copies = long_texts.select("__row", F.xxhash64("text").alias("tk")).join(known.where("copies > 1").select("tk"), "tk", "left_semi")
    marks = some.unionByName(copies.select("__row", F.lit(True).alias("__whole")), allowMissingColumns=True)
    return docs.join(marks, "__row", "left").select(*columns, "__spans", "__whole")


def _kept(text: bytes, whole: bool, spans: pa.Scalar) -> tuple[bytes, int]:
    """What is left of a text, and the number of runs removed."""
    if whole:  # null where nothing is known against the text
        return b"", 1
    if spans is None or not spans.is_valid:
        return text, 0
    gone = _merged(spans.values.field(0).to_numpy(), spans.values.field(1).to_numpy())
    ends = [0, *(b for _, b in gone)]
    starts = [*(a for a, _ in gone), len(text)]
    return b"".join(text[a:b] for a, b in zip(ends, starts, strict=True)), len(gone)


def removal_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400) -> DataFrame:
    """One row per row of `docs`: id, n_bytes, n_removed, n_spans and the SHA-256 of the bytes that stay.

    A byte goes if a string of `length` bytes that covers it starts anywhere
    else, in the same text or another; the input alone decides. Null texts
    count as empty; texts shorter than `length` bytes stay whole; of repeated
    texts no copy stays. Ids may be null or repeated. An empty table gives an
    empty table.
    """
    marked = _with_spans(docs.select(F.col(id_col), F.col(text_col)).toDF("id", "text"), "text", length)
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), *(T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")), T.StructField("kept_sha256", T.StringType())])

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, found = binary(batch.column(1)), []
            for i in range(batch.num_rows):
                text = texts[i].as_py()
                kept, n = _kept(text, batch.column(3)[i].as_py(), batch.column(2)[i])
                found.append((len(text), len(text) - len(kept), n, hashlib.sha256(kept).hexdigest()))
            columns = [pa.array(x) for x in zip(*found, strict=True)] if found else [pa.array([], pa.int64())] * 3 + [pa.array([], pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=schema.names)

    return marked.select("id", "text", "__spans", "__whole").mapInArrow(tidy(report), schema)


def remove_repeats(docs: DataFrame, text_col: str = "text", n_chars_col: str | None = "n_chars", length: int = 400) -> DataFrame:
    """`docs` with repeated strings cut out of its texts; all rows and columns stay.

    Bytes of a UTF-8 character of which only a part is removed go too. A null
    text stays null. n_chars_col, where there is such a column, is counted anew.
    """
    marked = _with_spans(docs, text_col, length)
    names = docs.columns
    at, n = names.index(text_col), len(names)

    def cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = binary(batch.column(at))
            new = [_kept(texts[i].as_py(), batch.column(n + 1)[i].as_py(), batch.column(n)[i])[0].decode("utf-8", "ignore") if batch.column(at)[i].is_valid else None for i in range(batch.num_rows)]
            columns = [*batch.columns[:at], pa.array(new, pa.string()), *batch.columns[at + 1 : n]]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    out = marked.select(*docs.columns, "__spans", "__whole").mapInArrow(tidy(cleaned), docs.schema)
    return out.withColumn(n_chars_col, F.length(text_col).cast(docs.schema[n_chars_col].dataType)) if n_chars_col in docs.columns else out
