"""Deep-shallow sorting of byte strings within groups.

Strings are first ordered by multikey quicksort to a shallow depth: a group is
parted by a pivot into strings whose word (8 bytes) at the depth at hand is
less, equal or greater; the equal ones go on a word deeper, the others at the
same depth. All groups are parted at once, a round for each level of parting.
The groups that still tie at the shallow depth share a long prefix and
are ordered by a blind trie each: a binary trie that keeps only the positions
of the bits where strings branch, so that a string is compared in full with
one other string only.
"""

from __future__ import annotations

import numpy as np

WORD = 8


def blind_trie_order(strings: list[bytes]) -> tuple[list[list[int]], list[int]]:
    """Indices of equal strings together, in order; and the common prefix in bytes of each with the one before it.

    All strings have the same length.
    """
    width = 8 * len(strings[0])
    values = [int.from_bytes(s, "big") for s in strings]
    leaves, member = [0], [[0]]  # a leaf's first string, and all of its strings
    bit: list[int] = []
    kids: list[list[int]] = []  # of inner nodes; ~k stands for leaf k
    root = -1
    for i in range(1, len(strings)):
        text, node = strings[i], root
        while node >= 0:
            b = bit[node]
            node = kids[node][text[b >> 3] >> (7 - (b & 7)) & 1]
        differing = values[i] ^ values[leaves[~node]]
        if not differing:
            member[~node].append(i)
            continue
        at = width - differing.bit_length()
        above, side, node = -1, 0, root
        while node >= 0 and bit[node] < at:
            b = bit[node]
            above, side = node, text[b >> 3] >> (7 - (b & 7)) & 1
            node = kids[node][side]
        leaves.append(i)
        member.append([i])
        own = text[at >> 3] >> (7 - (at & 7)) & 1
        bit.append(at)
        kids.append([~(len(leaves) - 1), node] if own == 0 else [node, ~(len(leaves) - 1)])
        if above < 0:
            root = len(bit) - 1
        else:
            kids[above][side] = len(bit) - 1
    order, common, way, node, shared = [], [], [], root, -1
    while True:
        while node >= 0:
            way.append(node)
            node = kids[node][0]
        order.append(member[~node])
        common.append(shared)
        if not way:
            return order, common
        node = way.pop()
        shared = bit[node] >> 3
        node = kids[node][1]


def common_prefix(a: bytes, b: bytes) -> int:
    differing = int.from_bytes(a, "big") ^ int.from_bytes(b, "big")
    return len(a) - (differing.bit_length() + 7) // 8


def multikey_quicksort(order: np.ndarray, words: np.ndarray, first: np.ndarray, size: np.ndarray) -> list[tuple[int, int]]:
    """Sorts `order` in place within the parts given by first and size, by rows of words; returns (first, size) of the parts that tie in all words."""
    depth = np.zeros(len(first), np.int64)
    ties: list[tuple[int, int]] = []
    while True:
        deep = depth == words.shape[1]
        ties += zip(first[deep & (size > 1)].tolist(), size[deep & (size > 1)].tolist(), strict=True)
        open_ = ~deep & (size > 1)
        first, size, depth = first[open_], size[open_], depth[open_]
        if not len(first):
            return sorted(ties)
        base = np.cumsum(size) - size
        part = np.repeat(np.arange(len(first)), size)
        at = np.arange(len(part)) - base[part] + first[part]
        rows = order[at]
        value = words[rows, depth[part]]
        # the middle one of the first, the middle and the last
        three = np.sort(np.stack([value[base], value[base + size // 2], value[base + size - 1]]), axis=0)
        pivot = three[1][part]
        side = (value >= pivot).astype(np.int64) + (value > pivot)
        counts = np.stack([np.add.reduceat(side == k, base, dtype=np.int64) for k in range(3)])
        starts = np.stack([first, first + counts[0], first + counts[0] + counts[1]])
        rank = np.empty(len(part), np.int64)
        for k in range(3):
            own = side == k
            before = np.cumsum(own) - own
            rank[own] = (before - before[base][part])[own]
        order[starts[side, part] + rank] = rows
        first, size = starts.ravel(), counts.ravel()
        depth = np.concatenate((depth, depth + 1, depth))


def deep_shallow_sort(group: np.ndarray, strings: list[bytes], width: int, shallow: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """Order of the strings within each group, and the bytes each has in common with the one before it, -1 at a group's first.

    group: ascending. Strings are compared as if filled up with zero bytes to `width`.
    """
    n = len(strings)
    order, common = np.arange(n), np.full(n, -1, np.int64)
    if not n:
        return order, common
    padded = [s.ljust(width, b"\0") for s in strings]
    depth = min(shallow, width) // WORD * WORD
    words = np.frombuffer(b"".join(s[:depth] for s in padded), ">u8").reshape(n, -1).astype(np.uint64)
    first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    for a, k in multikey_quicksort(order, words, first, np.diff(np.append(first, n))):
        own = order[a : a + k].tolist()
        classes, shared = blind_trie_order([padded[i] for i in own])
        order[a : a + k] = [own[i] for c in classes for i in c]
        common[a : a + k] = np.concatenate([[s] + [width] * (len(c) - 1) for c, s in zip(classes, shared, strict=True)])
    for a in np.flatnonzero(common < 0)[1:].tolist():
        i, j = order[a - 1], order[a]
        common[a] = common_prefix(padded[i], padded[j]) if group[i] == group[j] else -1
    return order, common
