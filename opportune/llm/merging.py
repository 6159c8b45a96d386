"""Merging of symbol pairs by rank, for many words at once.

`PairTable` is a hash table from symbol pairs to (rank, product); `merge_words` runs byte-pair merging in lockstep over a
batch of words with NumPy, `merge_one` handles a single very long word with a heap. Both give the exact result: the pair of
lowest rank is merged first, the leftmost among equals.
"""

from __future__ import annotations

import heapq

import numpy as np

NONE = np.iinfo(np.int32).max
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_MIX = np.uint64(0x9E3779B97F4A7C15)

#: Words of more symbols than this go through the heap, so that one long word doesn't widen a whole batch.
LONG_WORD = 48


class PairTable:
    """Open-addressing hash table of distinct (left, right) pairs with two int32 values each."""

    def __init__(self, left, right, rank, product):
        left, right = np.asarray(left, np.uint64), np.asarray(right, np.uint64)
        bits = max(4, int(2 * len(left) + 1).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys = np.full(1 << bits, _EMPTY)
        self.rank = np.full(1 << bits, NONE, np.int32)
        self.product = np.full(1 << bits, -1, np.int32)
        key, rank, product = left << np.uint64(32) | right, np.asarray(rank, np.int32), np.asarray(product, np.int32)
        slot = self._slot(key)
        while len(key):
            place = np.flatnonzero(self.keys[slot] == _EMPTY)
            place = place[np.unique(slot[place], return_index=True)[1]]
            at = slot[place]
            self.keys[at], self.rank[at], self.product[at] = key[place], rank[place], product[place]
            rest = np.ones(len(key), bool)
            rest[place] = False
            key, rank, product, slot = key[rest], rank[rest], product[rest], (slot[rest] + 1) & self.mask

    def _slot(self, key):
        with np.errstate(over="ignore"):
            return ((key * _MIX) >> self.shift).astype(np.int64)

    def find(self, left, right):
        """Slots of the pairs, -1 where the pair is absent."""
        key = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        slot = self._slot(key)
        found = self.keys[slot]
        out = np.where(found == key, slot, -1)
        todo = np.flatnonzero((found != key) & (found != _EMPTY))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & self.mask
            found = self.keys[slot[todo]]
            hit = found == key[todo]
            out[todo[hit]] = slot[todo[hit]]
            todo = todo[~hit & (found != _EMPTY)]
        return out

    def ranks(self, left, right):
        at = self.find(left, right)
        return np.where(at >= 0, self.rank[at], NONE)

    def products(self, left, right):
        at = self.find(left, right)
        return np.where(at >= 0, self.product[at], -1)

    def as_dict(self) -> dict:
        """Pair to (rank, product), for `merge_one`."""
        full = np.flatnonzero(self.keys != _EMPTY)
        key = self.keys[full]
        pairs = zip((key >> np.uint64(32)).tolist(), (key & np.uint64(0xFFFFFFFF)).tolist())
        return dict(zip(pairs, zip(self.rank[full].tolist(), self.product[full].tolist())))


def merge_one(symbols: list[int], pairs: dict) -> list[int]:
    """Exact merging of one word of any length in O(n log n): a heap of candidate pairs over a linked list."""
    n = len(symbols)
    sym, after, before = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(hit[0], i, hit[1], sym[i], sym[i + 1]) for i in range(n - 1) if (hit := pairs.get((sym[i], sym[i + 1])))]
    heapq.heapify(heap)
    while heap:
        _, i, made, a, b = heapq.heappop(heap)
        j = after[i] if sym[i] == a else n
        if j >= n or sym[j] != b:
            continue
        sym[i], sym[j] = made, -1
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        for x, y in ((before[i], i), (i, after[i])):
            if x >= 0 and y < n and (hit := pairs.get((sym[x], sym[y]))):
                heapq.heappush(heap, (hit[0], x, hit[1], sym[x], sym[y]))
    return [s for s in sym if s >= 0]


def merge_words(flat: np.ndarray, lens: np.ndarray, table: PairTable, pairs: dict | None = None):
    """Merge each word of the ragged batch (flat symbols, lengths); returns the ragged result (flat, lengths).

    pairs: `table.as_dict()`, needed only for words of more than LONG_WORD symbols; built here if absent.
    """
    lens = np.asarray(lens, np.int64)
    starts = np.cumsum(lens) - lens
    out_rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # (word numbers, lengths, padded rows)
    for lo, hi in ((0, 8), (8, 16), (16, LONG_WORD)):
        words = np.flatnonzero((lens > lo) & (lens <= hi))
        for part in np.array_split(words, max(1, -(-len(words) // 50_000))):
            if len(part):
                width = int(lens[part].max())
                cols = np.arange(width)
                inside = cols < lens[part][:, None]
                grid = np.where(inside, flat[np.where(inside, starts[part][:, None] + cols, 0)], -1).astype(np.int32)
                out_rows += _merge_grid(grid, part, table)
    long_words = np.flatnonzero(lens > LONG_WORD)
    if len(long_words):
        pairs = pairs if pairs is not None else table.as_dict()
        for w in long_words:
            row = np.array(merge_one(flat[starts[w] : starts[w] + lens[w]].tolist(), pairs), np.int32)
            out_rows.append((np.array([w]), np.array([len(row)]), row[None, :]))
    new = np.zeros(len(lens), np.int64)
    for who, size, _ in out_rows:
        new[who] = size
    at = np.cumsum(new) - new
    out = np.zeros(int(new.sum()), np.int32)
    for who, size, grid in out_rows:
        cols = np.arange(grid.shape[1])
        inside = cols < size[:, None]
        out[(at[who][:, None] + cols)[inside]] = grid[inside]
    return out, new


def _merge_grid(grid: np.ndarray, who: np.ndarray, table: PairTable) -> list:
    done, (n, width) = [], grid.shape
    rank = np.full((n, width), NONE, np.int32)
    if width > 1:
        both = grid[:, 1:] >= 0
        rank[:, :-1][both] = table.ranks(grid[:, :-1][both], grid[:, 1:][both])
    while len(grid):
        best = rank.argmin(1)
        rows = np.arange(len(grid))
        open_ = rank[rows, best] < NONE
        if not open_.all():
            shut = ~open_
            done.append((who[shut], (grid[shut] >= 0).sum(1), grid[shut]))
            grid, rank, who, best = grid[open_], rank[open_], who[open_], best[open_]
            rows = rows[: len(grid)]
            if not len(grid):
                break
        made = table.products(grid[rows, best], grid[rows, best + 1])
        tail = np.arange(grid.shape[1] - 1) > best[:, None]
        grid[:, :-1] = np.where(tail, grid[:, 1:], grid[:, :-1])
        rank[:, :-1] = np.where(tail, rank[:, 1:], rank[:, :-1])
        grid[:, -1], rank[:, -1] = -1, NONE
        grid[rows, best] = made
        for at in (best - 1, best):
            here = np.flatnonzero(at >= 0)
            left, right = grid[here, at[here]], grid[here, np.minimum(at[here] + 1, grid.shape[1] - 1)]
            ok = (right >= 0) & (at[here] + 1 < grid.shape[1])
            fresh = np.full(len(here), NONE, np.int32)
            fresh[ok] = table.ranks(left[ok], right[ok])
            rank[here, at[here]] = fresh
    return done
