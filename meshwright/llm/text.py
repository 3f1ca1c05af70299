"""Vectorised handling of text batches: Arrow columns as byte arrays, words, rolling hashes."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: The bytes that separate words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes that continue a UTF-8 character; all others start one.
CONTINUES = (np.arange(256) & 0xC0) == 0x80

BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
MIX = np.uint64(0xD6E8FEB86659FD93)
BYTE_VALUE = np.random.default_rng(20_26).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

_powers = {BASE: np.ones(1, np.uint64), BASE_INVERSE: np.ones(1, np.uint64)}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    if len(_powers[base]) < n:
        steps = np.full(max(n, 1 << 20), base, np.uint64)
        steps[0] = 1
        _powers[base] = np.cumprod(steps)
    return _powers[base][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit values that spreads every input bit."""
    x = (x ^ (x >> np.uint64(32))) * MIX
    x = (x ^ (x >> np.uint64(29))) * MIX
    return x ^ (x >> np.uint64(32))


def binary(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """The column as large_binary, null as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_null(column.type):
        return pa.array([b""] * len(column), pa.large_binary())
    if not pa.types.is_large_binary(column.type):
        column = column.cast(pa.large_string() if pa.types.is_string(column.type) else pa.large_binary())
        column = column.cast(pa.large_binary())
    return column.fill_null(b"") if column.null_count else column


try:
    _TRIM = ctypes.CDLL(None).malloc_trim  # glibc alone has it
except (AttributeError, OSError, TypeError):
    _TRIM = None


def give_back() -> None:
    """Give unused memory of Arrow and of the C heap back to the system, which arrays of some megabytes come from."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def tidy(rows):
    """The same function of batches, which gives unused memory back when a task ends, for workers live on."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from rows(batches)
        finally:
            give_back()

    return tidied


def tidy_group(of: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """The same function of a group's table, which gives unused memory back after each group."""

    def tidied(table: pa.Table) -> pa.Table:
        try:
            return of(table)
        finally:
            give_back()

    return tidied


def slices(column: pa.Array | pa.ChunkedArray, most: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole rows of about `most` bytes (one longer row alone): first row, end row, bytes, offsets."""
    column = binary(column)
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1)
        end = min(end, len(column))
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


class Words:
    """The words of some texts. `data` has a line feed before each text and after the last one."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        self.n_docs = len(offsets) - 1
        self.first = offsets[:-1] + np.arange(1, self.n_docs + 1)  # of each text in self.data
        self.end = offsets[1:] + np.arange(1, self.n_docs + 1)
        self.data = np.full(len(data) + self.n_docs + 1, 10, np.uint8)
        texts = np.ones(len(self.data), bool)
        texts[0] = False
        texts[self.end] = False
        self.data[texts] = LOWER[data] if lower else data
        space = SPACE[self.data]
        self.starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
        self.ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
        self.space = space
        self.counts = np.searchsorted(self.starts, self.end) - np.searchsorted(self.starts, self.first)
        self.doc = np.repeat(np.arange(self.n_docs), self.counts)

    def prefix(self) -> np.ndarray:
        """Sums from which span_hash() takes the hash of any span of self.data."""
        return prefix_hash(self.data)

    def per_doc(self, values: np.ndarray) -> np.ndarray:
        """Sums of a value of each word by text."""
        return np.bincount(self.doc, values, self.n_docs)


def shingle_spans(words: Words, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words joined by one space; text, first and end byte of each word n-gram, one of all words in a shorter text."""
    lengths = words.ends - words.starts
    after = np.zeros(len(words.data), bool)
    after[words.ends] = True
    joined = words.data[after | ~words.space]
    joined[np.cumsum(lengths + 1) - 1] = 32
    start = np.concatenate(([0], np.cumsum(lengths + 1)))
    counts = np.minimum(words.counts, np.maximum(words.counts - n + 1, 1))  # shingles of each text
    doc = np.repeat(np.arange(words.n_docs), counts)
    at = np.arange(len(doc)) - (np.cumsum(counts) - counts)[doc] + (np.cumsum(words.counts) - words.counts)[doc]
    return joined, doc, start[at], start[at + np.minimum(n, words.counts[doc])] - 1


def prefix_hash(data: np.ndarray) -> np.ndarray:
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUE[data] * powers(BASE, len(data)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit polynomial hashes of spans, equal for equal bytes wherever they stand."""
    return mixed((prefix[ends] - prefix[starts]) * powers(BASE_INVERSE, len(prefix))[starts] + (ends - starts).astype(np.uint64))


def repeats(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: does it occur twice or more; is it equal to an earlier one."""
    twice, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    if len(keys) > 1:
        order = np.argsort(keys, kind="stable")
        same = keys[order[1:]] == keys[order[:-1]]
        later[order[1:][same]] = True
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
    return twice, later
