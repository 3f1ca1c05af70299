"""Byte-pair encoding with reuse of content-defined chunks.

A rolling hash over the last bytes cuts texts into chunks at places that
depend on content alone, so passages that documents share fall into equal
chunks. A task encodes each distinct chunk once and keeps its ids for as long
as they fit. Where a cut splits a word, the join is repaired: the text from
some words before the split word to some words after it is encoded anew, and
takes the place of the chunks' own ids between tokens on which both agree, the
last that ends a word before the split one and the first that follows a word's
end after it. If they don't agree, more words are looked at, in the end the
whole text.

What is new in a chunk or a span is itself put together from strings between
white space, each encoded once while it is kept, where the tokenizer's
description shows that no token and no rule reaches across white space.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from tokenizers import Tokenizer

from meshwright.llm.text import BASE_INVERSE, CONTINUES, SPACE, powers, prefix_hash, slices

SLICE_BYTES = 2_000_000
#: Bytes of chunks and their ids that a task keeps for its next texts.
KEPT_BYTES = 96_000_000
#: Bytes of strings between white space, and of their ids, that a task keeps.
KEPT_WORD_BYTES = 96_000_000
#: Bytes the rolling hash looks back on, and the mean length of a chunk as a power of two.
WINDOW, CHUNK_BITS = 12, 12
#: Words beside a split one that are looked at for agreement, in turn; then the whole text is encoded.
CONTEXTS = (1, 4, 16)


def _apart_at_space(text: dict) -> bool:
    """Whether a tokenizer, by its description, encodes a text as the strings between its ASCII white space one after another.

    So it does if words are what a pattern matches in which `\\s` stands in
    negated sets only and that doesn't look around, if other steps change
    characters one by one (NFC composes nothing with a space), and if added
    tokens are plain strings without white space.
    """
    steps = text.get("normalizer") or {"type": "Sequence", "normalizers": []}
    steps = steps.get("normalizers", [steps])
    idle = {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}
    before = text.get("pre_tokenizer") or {}
    split, *rest = before.get("pretokenizers") or [before]
    pattern = (split.get("pattern") or {}).get("Regex", ".")
    return (
        all(x.get("type") in ("NFC", "Lowercase") or x == idle for x in steps)
        and split.get("type") == "Split" and split.get("behavior") == "Removed" and bool(split.get("invert"))
        and re.fullmatch(r"[^\\\s.^$()*?{}&-]*", re.sub(r"\\p\{[LN]\}", "", pattern.replace("[^\\s", "["))) is not None
        and all(x.get("type") == "ByteLevel" and not x.get("add_prefix_space") and not x.get("use_regex", True) for x in rest)
        and (text.get("model") or {}).get("type") == "BPE" and not text["model"].get("dropout")
        and all(not re.search(r"\s", x["content"]) and not any(x.get(k) for k in ("single_word", "lstrip", "rstrip", "normalized")) for x in text.get("added_tokens") or [])
    )


def _without_idle_step(path: str) -> str:
    """The tokenizer's description without a normalizer that turns runs of white space into a space, if its words never hold white space.

    That step takes a sixth of the time. Words never hold any if they are what a pattern matches in which `\\s` stands in negated sets only.
    """
    with open(path, encoding="utf-8") as f:
        text = json.load(f)
    splits = (text.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    pattern = (splits[0].get("pattern") or {}).get("Regex", ".")
    matched = splits[0].get("type") == "Split" and splits[0].get("behavior") == "Removed" and splits[0].get("invert")
    if matched and not re.search(r"\\[sWDPX]| |\.|\[\^", pattern.replace("[^\\s", "")):
        steps = (text.get("normalizer") or {}).get("normalizers") or []
        idle = {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}
        if idle in steps:
            text["normalizer"]["normalizers"] = [x for x in steps if x != idle]
    return json.dumps(text)


@lru_cache(maxsize=4)
def _tokenizer(path: str) -> tuple[Tokenizer, list[str], bool]:
    """The tokenizer without truncation and padding, its token strings by id, and _apart_at_space(); a string that ends a word ends in `</w>`."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    tokenizer = Tokenizer.from_str(_without_idle_step(path))
    tokenizer.no_truncation()
    tokenizer.no_padding()
    strings = [""] * tokenizer.get_vocab_size(with_added_tokens=True)
    for token, i in tokenizer.get_vocab(with_added_tokens=True).items():
        strings[i] = token
    with open(path, encoding="utf-8") as f:
        return tokenizer, strings, _apart_at_space(json.load(f))


def chunk_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where chunks start: at every text, and at the first character after every WINDOW bytes whose hash ends in CHUNK_BITS zeros."""
    n = len(data)
    starts = np.zeros(n + 4, bool)
    starts[offsets[:-1]] = True
    if n >= WINDOW:
        prefix, at = prefix_hash(data), np.arange(n - WINDOW + 1)
        rolling = (prefix[WINDOW:] - prefix[:-WINDOW]) * powers(BASE_INVERSE, n + 1)[at]
        cuts = np.flatnonzero(rolling >> np.uint64(64 - CHUNK_BITS) == 0) + WINDOW
        inside = np.append(CONTINUES[data], [False] * 4)
        for _ in range(3):  # no cut goes through a character
            cuts = cuts + inside[cuts]
        starts[cuts] = True
    return np.flatnonzero(starts[:n])


class ChunkCodes:
    """Ids of strings, each encoded once while it is kept."""

    def __init__(self, path: str):
        self.tokenizer, self.strings, self.apart = _tokenizer(path)
        self.ends_word = np.array([w.endswith("</w>") for w in self.strings])
        self.kept: dict[bytes, np.ndarray] = {}
        self.size = 0
        self.words: dict[bytes, bytes] = {}  # ids as numbers of 32 bits
        self.words_size = 0

    def encoded(self, texts: list[bytes]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]

    def fresh(self, texts: list[bytes]) -> list[np.ndarray]:
        if not self.apart:
            return [np.array(ids, np.uint32) for ids in self.encoded(texts)]
        if self.words_size > KEPT_WORD_BYTES:
            self.words, self.words_size = {}, 0
        parts = [t.split() for t in texts]  # at what SPACE holds
        new = list(set(chain.from_iterable(parts)).difference(self.words))
        for w, ids in zip(new, self.encoded(new), strict=True):
            self.words[w] = array("I", ids).tobytes()
            self.words_size += len(w) + 4 * len(ids) + 180
        return [np.frombuffer(b"".join(map(self.words.__getitem__, ws)), np.uint32) for ws in parts]

    def ids(self, texts: list[bytes]) -> list[np.ndarray]:
        if self.size > KEPT_BYTES:
            self.kept, self.size = {}, 0
        new = list({t: None for t in texts if t not in self.kept})
        for t, ids in zip(new, self.fresh(new), strict=True):
            self.kept[t] = ids
            self.size += len(t) + ids.nbytes + 200
        return [self.kept[t] for t in texts]


def _alike(a: np.ndarray, b: np.ndarray) -> int:
    """The length of the common prefix of two id arrays."""
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    return int(differ[0]) if len(differ) else n


def _agreed(chunk: np.ndarray, edge: np.ndarray, anew: np.ndarray, whole: bool, ends: np.ndarray) -> tuple[int, int] | None:
    """How many ids of the left chunk stay, and from which id of the span encoded anew it goes on.

    edge: ids of the part of the chunk that the span has too; whole: the chunk has nothing before it.
    """
    own = len(edge) - _alike(edge[::-1], chunk[::-1])  # from here on the edge's ids are the chunk's
    common = _alike(edge, anew)
    while common > own and not ends[edge[common - 1]]:
        common -= 1
    if common > own or (whole and own == 0):
        common = max(common, own)
        return len(chunk) - len(edge) + common, common
    return None


def _agreed_after(chunk: np.ndarray, edge: np.ndarray, anew: np.ndarray, whole: bool, ends: np.ndarray) -> tuple[int, int] | None:
    """How many of the first ids of the right chunk go, and how many of the last ids of the span encoded anew."""
    own = _alike(edge, chunk)  # so many ids of the edge are the chunk's
    common = _alike(edge[::-1], anew[::-1])
    first = len(edge) - common
    while first < own and not (first and ends[edge[first - 1]]):
        first += 1
    if first < own or (whole and own == len(edge)):
        return first, len(edge) - first
    return None


def encode_slice(data: np.ndarray, offsets: np.ndarray, codes: ChunkCodes) -> list[np.ndarray]:
    """The ids of each text of a slice."""
    n, n_docs = len(data), len(offsets) - 1
    none = np.zeros(0, np.uint32)
    if not n:
        return [none] * n_docs
    text = data.tobytes()
    space = np.ones(n + 2, bool)  # space[i + 1] is of byte i
    space[1:-1] = SPACE[data]
    opens = np.zeros(n + 1, bool)
    opens[offsets] = True  # no word goes on across the start of a text
    first = np.flatnonzero(~space[1:-1] & (space[:-2] | opens[:-1]))  # of each word, and its end
    end = np.flatnonzero(~space[1:-1] & (space[2:] | opens[1:])) + 1
    start = chunk_starts(data, offsets)
    stop = np.append(start[1:], n)
    chunks = codes.ids([text[a:b] for a, b in zip(start.tolist(), stop.tolist(), strict=True)])
    # joins: words that a cut splits, with the chunks they begin and end in
    a, b = np.searchsorted(start, first, "right") - 1, np.searchsorted(start, end - 1, "right") - 1
    split = np.flatnonzero(a < b)
    head, tail = {}, {}  # of chunks: ids that stay up to a join, and from one on; of a join: its ids
    middle: dict[int, np.ndarray] = {}
    swallowed = np.zeros(len(start), bool)
    open_ = split.tolist()
    for words in CONTEXTS:
        if not open_:
            break
        spans = []
        for w in open_:
            i, j = int(a[w]), int(b[w])
            before, after = w, w
            while before > 0 and w - before < words and first[before - 1] >= start[i]:
                before -= 1
            while after + 1 < len(first) and after - w < words and end[after + 1] <= stop[j]:
                after += 1
            spans.append((w, i, j, int(first[before]), int(end[after]), before > 0 and first[before - 1] >= start[i], after + 1 < len(first) and first[after + 1] < stop[j]))
        encoded = codes.fresh([x for w, i, j, p, q, *_ in spans for x in (text[p : stop[i]], text[start[j] : q], text[p:q])])
        open_ = []
        for k, (w, i, j, _, _, more_before, more_after) in enumerate(spans):
            left, right, anew = encoded[3 * k : 3 * k + 3]
            x = _agreed(chunks[i], left, anew, not more_before, codes.ends_word)
            y = _agreed_after(chunks[j], right, anew, not more_after, codes.ends_word)
            if x is None or y is None or x[1] > len(anew) - y[1]:
                open_.append(w)
                continue
            head[i], tail[j], middle[i] = x[0], y[0], anew[x[1] : len(anew) - y[1]]
            swallowed[i + 1 : j] = True
    doc_first = np.searchsorted(start, offsets)
    out = []
    again = set((np.searchsorted(offsets, first[open_], "right") - 1).tolist())
    for d in range(n_docs):
        if d in again:
            out += codes.fresh([text[offsets[d] : offsets[d + 1]]])
            continue
        parts = []
        for c in range(int(doc_first[d]), int(doc_first[d + 1])):
            if not swallowed[c]:
                parts.append(chunks[c][tail.get(c, 0) : head.get(c)])
            if c in middle:
                parts.append(middle[c])
        out.append(np.concatenate(parts) if len(parts) > 1 else parts[0] if parts else none)
    return out


def encode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per row of `docs`: id, n_tokens, SHA-256 of the ids (little-endian, 32 bits) and of the decoded text; with_ids adds the ids and the text.

    Texts are encoded whole, without special tokens added; strings of special
    tokens in a text become those tokens. Decoding joins the tokens by spaces,
    as a tokenizer without decoder does. A null, empty or wordless text has no
    tokens. Ids may be null or repeated. An empty table gives an empty table.
    tokenizer_path must hold the file on every executor.
    """
    source = docs.select(id_col, text_col)
    fields = [source.schema[0], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    if with_ids:
        fields += [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]
    schema = T.StructType(fields)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = ChunkCodes(tokenizer_path)
        strings = np.array(codes.strings, object)
        for batch in batches:
            for row, end, data, offsets in slices(batch.column(1), SLICE_BYTES):
                rows = []
                for ids in encode_slice(data, offsets, codes):
                    decoded = " ".join(strings[ids].tolist()).encode()
                    found = [len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(decoded).hexdigest()]
                    rows.append([*found, ids.astype(np.int32), decoded.decode()] if with_ids else found)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, end - row), *(pa.array(x, f) for x, f in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string()), strict=False))], names=schema.names)

    return source.mapInArrow(encoded, schema)
