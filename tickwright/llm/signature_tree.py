"""Links inside a bounded block of shingle sets, by a signature tree.

A leaf is a set with a bitmap of its hashed shingles.  A node above holds the OR of its
children's bitmaps and the range of their sizes.  Two trees (or a tree and itself) are gone
through together from the roots: a pair of nodes is left aside if no two sets below them can be
similar enough, by their sizes or by the largest overlap that the bitmaps leave possible, or if
all sets below are in one component already.  Pairs of leaves that remain are counted exactly.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

FANOUT = 8
#: Bits of a leaf for each shingle of an average set, and the bounds of a bitmap.
BITS_PER_SHINGLE, LEAST_BITS, MOST_BITS = 4, 256, 16_384
_PAIRS, _WORDS = 1 << 15, 1 << 21
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Rule:
    """When two sets are similar: ``100 * shared >= percent * united``.

    With ``more``, only the heads of the sets are there, and the question is whether they may be
    similar: heads of sets that are have 1 and ``more`` percent of what the smaller set needs in
    common (see ``ngram_join.py``).
    """

    percent: int
    more: int | None = None

    def least(self, a, b):
        """So much must sets of these sizes, or their heads, have in common."""
        if self.more is None:
            return -(-self.percent * (a + b) // (100 + self.percent))
        needed = (self.percent * np.minimum(a, b) + 99) // 100
        return 1 + self.more * needed // 100


def _rows_of(sizes: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(sizes)), sizes)


def _bitmaps(places: np.ndarray, rows: np.ndarray, count: int, bits: int) -> np.ndarray:
    """One bitmap a row; places are bit numbers."""
    words = -(-bits // 64)
    keys = np.unique(rows.astype(np.int64) * (words * 64) + places.astype(np.int64))
    bitmap = np.zeros(count * words, dtype=np.uint64)
    if len(keys):
        word, bit = keys >> 6, np.uint64(1) << (keys & 63).astype(np.uint64)
        starts = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
        bitmap[word[starts]] = np.bitwise_or.reduceat(bit, starts)
    return bitmap.reshape(count, words)


class Sets:
    """Sorted shingle sets one after another, with what exact counts need: a bitmap over the
    shingles that more than one of them has."""

    def __init__(self, values: np.ndarray, sizes: np.ndarray):
        self.values, self.sizes = values, sizes
        _, code, counts = np.unique(values, return_inverse=True, return_counts=True)
        shared = counts > 1
        number = np.cumsum(shared) - 1
        often = shared[code]
        self.exact = _bitmaps(number[code[often]], _rows_of(sizes)[often], len(sizes), max(1, int(shared.sum())))

    def overlap(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        step = max(1, _WORDS // self.exact.shape[1])
        parts = [np.bitwise_count(self.exact[a[at:at + step]] & self.exact[b[at:at + step]]).sum(axis=1, dtype=np.int64)
                 for at in range(0, len(a), step)]
        return np.concatenate(parts) if parts else np.empty(0, dtype=np.int64)


class Tree:
    """Levels from leaves to root over some rows of :class:`Sets`, alike sets side by side.

    A level has the bitmaps, the least and greatest size of the sets, the most shingles that one
    of them has here, and the most that hide behind others in a bitmap.
    """

    def __init__(self, sets: Sets, n: np.ndarray, rows: np.ndarray, bits: int):
        starts = np.concatenate(([0], np.cumsum(sets.sizes)[:-1]))
        mixed = (sets.values.view(np.uint64) * _FACTOR) >> np.uint64(20)
        least = np.minimum.reduceat(mixed, starts)[rows]
        self.rows = rows[np.lexsort((n[rows], least))]
        maps = _bitmaps(mixed & np.uint64(bits - 1), _rows_of(sets.sizes), len(sets.sizes), bits)[self.rows]
        here = sets.sizes[self.rows]
        hidden = here - np.bitwise_count(maps).sum(axis=1, dtype=np.int64)
        self.levels = [(maps, n[self.rows], n[self.rows], here, hidden)]
        while len(self.levels[-1][0]) > FANOUT:
            self.add_level()

    def add_level(self) -> None:
        maps, low, *most = self.levels[-1]
        at = np.arange(0, len(maps), FANOUT)
        self.levels.append((np.bitwise_or.reduceat(maps, at), np.minimum.reduceat(low, at),
                            *[np.maximum.reduceat(values, at) for values in most]))

    def labels(self, label: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Smallest and largest component below each node, by level."""
        own = label[self.rows]
        found = [(own, own)]
        for maps, *_ in self.levels[1:]:
            at = np.arange(len(maps)) * FANOUT
            found.append((np.minimum.reduceat(found[-1][0], at), np.maximum.reduceat(found[-1][1], at)))
        return found


def _possible(left: Tree, right: Tree, level: int, i: np.ndarray, j: np.ndarray, rule: Rule) -> np.ndarray:
    """Can any two sets below the nodes be similar enough?"""
    maps_a, low_a, high_a, here_a, hidden_a = left.levels[level]
    maps_b, low_b, high_b, here_b, hidden_b = right.levels[level]
    able = (100 * high_a[i] >= rule.percent * low_b[j]) & (100 * high_b[j] >= rule.percent * low_a[i])
    i, j = i[able], j[able]
    common = np.bitwise_count(maps_a[i] & maps_b[j]).sum(axis=1, dtype=np.int64)
    most = np.minimum(np.minimum(hidden_a[i], hidden_b[j]) + common, np.minimum(here_a[i], here_b[j]))
    able[able] = most >= rule.least(low_a[i], low_b[j])
    return able


def _children(tree: Tree, level: int, nodes: np.ndarray) -> np.ndarray:
    """Matrix of the nodes' children a level below; -1 where there is none."""
    found = nodes[:, None] * FANOUT + np.arange(FANOUT)
    return np.where(found < len(tree.levels[level - 1][0]), found, -1)


def forest(values: np.ndarray, sizes: np.ndarray, label: np.ndarray, side: np.ndarray, rule: Rule,
           n: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links (row, row) that join all rows which similar pairs join, beyond those with equal
    labels.  Sides 1 and 2 are compared with each other; where there is only one side, it is
    compared with itself.  ``n`` are the sizes of the whole sets where only heads are given.  No
    set may be empty."""
    if len(sizes) < 2:
        return []
    sets = Sets(values, sizes)
    n = sizes if n is None else n
    label = np.unique(label, return_inverse=True)[1]
    found: list[tuple[int, int]] = []

    def link(a: np.ndarray, b: np.ndarray) -> None:
        """Count pairs exactly and join the components of similar ones."""
        for at in range(0, len(a), 4096):
            x, y = a[at:at + 4096], b[at:at + 4096]
            apart = label[x] != label[y]
            x, y = x[apart], y[apart]
            alike = 100 * np.minimum(n[x], n[y]) >= rule.percent * np.maximum(n[x], n[y])
            near = alike & (sets.overlap(x, y) >= rule.least(n[x], n[y]))
            for one, other in zip(x[near].tolist(), y[near].tolist(), strict=True):
                if label[one] != label[other]:
                    found.append((one, other))
                    label[label == label[other]] = label[one]

    rows = np.arange(len(sizes))
    alone = len(np.unique(side)) < 2
    mean = int(sizes.mean())
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_PER_SHINGLE * mean - 1).bit_length()))
    left = Tree(sets, n, rows if alone else rows[side == 1], bits)
    right = left if alone else Tree(sets, n, rows[side == 2], bits)
    while len(left.levels) != len(right.levels):
        (left if len(left.levels) < len(right.levels) else right).add_level()
    top = len(left.levels) - 1
    i, j = (grid.ravel() for grid in np.indices((len(left.levels[top][0]), len(right.levels[top][0]))))
    todo = [(top, i, j)]
    joined, components = -1, ([], [])
    while todo:
        level, i, j = todo.pop()
        if len(i) > _PAIRS:
            todo += [(level, i[at:at + _PAIRS], j[at:at + _PAIRS]) for at in range(0, len(i), _PAIRS)]
            continue
        if alone:
            ordered = i <= j if level else i < j
            i, j = i[ordered], j[ordered]
        if joined != len(found):
            joined, components = len(found), (left.labels(label), right.labels(label))
        (low_a, high_a), (low_b, high_b) = components[0][level], components[1][level]
        one = (low_a[i] == high_a[i]) & (low_b[j] == high_b[j]) & (low_a[i] == low_b[j])
        i, j = i[~one], j[~one]
        able = _possible(left, right, level, i, j, rule)
        i, j = i[able], j[able]
        if level == 0:
            link(left.rows[i], right.rows[j])
        elif len(i):
            a, b = _children(left, level, i), _children(right, level, j)
            a, b = np.repeat(a, FANOUT, axis=1).ravel(), np.tile(b, (1, FANOUT)).ravel()
            real = (a >= 0) & (b >= 0)
            todo.append((level - 1, a[real], b[real]))
    return found
