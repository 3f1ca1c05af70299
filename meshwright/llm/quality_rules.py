"""Quality rules by repetition coverage.

Rolling hashes over the word sequence give every n-gram of several lengths a
64-bit value; the characters inside n-grams that occur twice or more in a text,
and inside lines that repeat an earlier line, are measured against all word
characters. A length is only looked at where the next shorter length repeats,
for an n-gram can't occur twice if its first part doesn't.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from meshwright.llm.text import CONTINUES, MIX, Words, mixed, repeats, slices, span_hash, tidy

SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
STEP = np.uint64(0xC2B2AE3D27D4EB4F)
SLICE_BYTES = 1_000_000


@dataclass(frozen=True)
class Rules:
    """A text is rejected if a share of its word characters exceeds the limit of its n-gram length, or of lines."""

    min_words: int = 50
    max_repeat_words_percent: int = 50
    coverage: tuple[tuple[int, float], ...] = ((4, 0.45), (6, 0.42), (8, 0.40), (10, 0.38))
    line_coverage: float = 0.30

    @property
    def lengths(self) -> tuple[int, ...]:
        return tuple(n for n, _ in self.coverage)


def measure(data: np.ndarray, offsets: np.ndarray, rules: Rules) -> dict[str, np.ndarray]:
    """The figures and the verdict of each text of a slice."""
    words = Words(data, offsets)
    n_docs, doc = words.n_docs, words.doc
    prefix = words.prefix()
    code_points = np.concatenate(([0], np.cumsum(~CONTINUES[words.data])))
    chars = code_points[words.ends] - code_points[words.starts]
    total = words.per_doc(chars).astype(np.int64)
    symbols = np.concatenate(([0], np.cumsum(SYMBOL[words.data])))
    out = {"n_words": words.counts.astype(np.int64), "word_chars": total, "n_symbols": symbols[words.end] - symbols[words.first]}

    breaks = np.flatnonzero(words.data == 10)
    first, end = breaks[:-1] + 1, breaks[1:]
    held = np.searchsorted(words.starts, end) - np.searchsorted(words.starts, first)
    first, end = first[held > 0], end[held > 0]
    line_doc = np.searchsorted(words.first, first, "right") - 1
    _, later = repeats(mixed(span_hash(prefix, first, end) ^ (line_doc.astype(np.uint64) * MIX)))
    out["n_dup_lines"] = np.bincount(line_doc[later], minlength=n_docs).astype(np.int64)
    char_sum = np.concatenate(([0], np.cumsum(chars)))
    inside = char_sum[np.searchsorted(words.starts, end)] - char_sum[np.searchsorted(words.starts, first)]
    shares = {"line_coverage": np.bincount(line_doc[later], inside[later], n_docs)}

    word = span_hash(prefix, words.starts, words.ends)
    rolling, factor, at = word.copy(), np.uint64(1), np.arange(len(word))
    last = np.cumsum(words.counts)[doc] if len(doc) else doc  # one past the last word of the text
    for n in range(2, max(3, *rules.lengths) + 1):
        with np.errstate(over="ignore"):
            factor = factor * STEP
        at = at[at + n <= last[at]]
        rolling[at] += word[at + n - 1] * factor
        if n != 3 and n not in rules.lengths:
            continue
        twice, _ = repeats(mixed(rolling[at] ^ (doc[at].astype(np.uint64) * MIX)))
        at = at[twice]
        edges = np.bincount(at, minlength=len(word) + 1) - np.bincount(at + n, minlength=len(word) + 1)
        covered = np.cumsum(edges)[:-1] > 0
        if n == 3:
            out["n_repeat_words"] = words.per_doc(covered).astype(np.int64)
        if n in rules.lengths:
            shares[f"coverage_{n}"] = words.per_doc(covered * chars)
    for name, sums in shares.items():
        out[name] = sums / np.maximum(total, 1)
    out["base_failed"] = (out["n_words"] < rules.min_words) | (100 * out["n_repeat_words"] > rules.max_repeat_words_percent * out["n_words"])
    over = out["line_coverage"] > rules.line_coverage
    for n, most in rules.coverage:
        over |= out[f"coverage_{n}"] > most
    out["kept"] = ~out["base_failed"] & ~over
    return out


def _columns(rules: Rules) -> list[tuple[str, T.DataType]]:
    counts = [(c, T.LongType()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    shares = [(c, T.DoubleType()) for c in ("line_coverage", *(f"coverage_{n}" for n in rules.lengths))]
    return [*counts, *shares, ("base_failed", T.BooleanType()), ("kept", T.BooleanType())]


def repetition_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Rules = Rules()) -> DataFrame:
    """One row per row of `docs`: its id, the counts, the covered shares, base_failed and kept.

    Null and empty texts have no words: all counts 0, base_failed true, kept
    false. Ids may be null or repeated; each row is judged alone, and other
    columns of `docs` are not looked at. An empty table gives an empty table.
    """
    source = docs.select(id_col, text_col)
    columns = _columns(rules)
    schema = T.StructType([source.schema[0], *(T.StructField(c, t) for c, t in columns)])

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, offsets in slices(batch.column(1), SLICE_BYTES):
                found = measure(data, offsets, rules)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, end - row), *(pa.array(found[c]) for c, _ in columns)], names=schema.names)

    return source.mapInArrow(report, schema)


def quality_filter(docs: DataFrame, text_col: str = "text", rules: Rules = Rules()) -> DataFrame:
    """The rows of `docs` that repetition_report() keeps, with all their columns, in one pass without a shuffle.

    Null, empty and short texts go; repeated rows are judged alike. An empty
    table gives an empty table.
    """
    at = docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, offsets in slices(batch.column(at), SLICE_BYTES):
                kept = batch.slice(row, end - row).filter(pa.array(measure(data, offsets, rules)["kept"]))
                if kept.num_rows:
                    yield kept

    return docs.mapInArrow(tidy(keep), docs.schema)
