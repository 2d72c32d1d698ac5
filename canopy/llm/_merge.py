"""Byte-pair merging of many short symbol sequences at once, with a cache of finished words."""

from __future__ import annotations

import heapq

import numpy as np

from canopy.llm._arrays import offsets_of, ragged

_NONE = np.int32(2**31 - 1)
_LONG = 48


class PairTable:
    """(left, right) -> (priority, merged id), as an open-addressing table for array look-ups."""

    def __init__(self, left: np.ndarray, right: np.ndarray, priority: np.ndarray, merged: np.ndarray):
        bits = max(10, int(len(left) * 4).bit_length())
        self.mask = np.int64((1 << bits) - 1)
        self.keys = np.full(1 << bits, -1, np.int64)
        self.priority = np.full(1 << bits, _NONE, np.int32)
        self.merged = np.zeros(1 << bits, np.int32)
        key = left.astype(np.int64) << 32 | right.astype(np.int64)
        todo, slot = np.arange(len(key)), self._slot(key)
        while len(todo):
            free = self.keys[slot] < 0
            first = np.zeros(len(todo), bool)
            first[np.unique(slot, return_index=True)[1]] = True
            put = free & first
            at = slot[put]
            self.keys[at], self.priority[at], self.merged[at] = key[todo[put]], priority[todo[put]], merged[todo[put]]
            todo, slot = todo[~put], (slot[~put] + 1) & self.mask

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key * np.int64(0x2545F4914F6CDD1D)) >> np.int64(30)) & self.mask

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Priority (or the largest int) and merged id of each pair; negative symbols never match."""
        key = left.astype(np.int64) << 32 | right.astype(np.int64)
        slot = self._slot(key)
        found = self.keys[slot]
        todo = np.flatnonzero((found != key) & (found >= 0))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & self.mask
            found = self.keys[slot[todo]]
            todo = todo[(found != key[todo]) & (found >= 0)]
        hit = (self.keys[slot] == key) & (left >= 0) & (right >= 0)
        return np.where(hit, self.priority[slot], _NONE), self.merged[slot]

    def merge(self, symbols: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge every sequence by repeatedly joining its leftmost pair of lowest priority."""
        lengths = np.diff(offsets)
        out: list = [None] * len(lengths)
        order = np.argsort(lengths, kind="stable")
        sizes = lengths[order]
        at = 0
        while at < len(order):
            n = int(sizes[at])
            if n > _LONG:
                for k in order[at:]:
                    out[k] = self._merge_long(symbols[offsets[k] : offsets[k + 1]])
                break
            end = int(np.searchsorted(sizes, n, side="right"))
            for lo in range(at, end, 20_000):
                rows = order[lo : min(end, lo + 20_000)]
                for k, ids in zip(rows.tolist(), self._merge_block(symbols[offsets[rows][:, None] + np.arange(n)]), strict=True):
                    out[k] = ids
            at = end
        counts = np.fromiter(map(len, out), np.int64, len(out))
        return (np.concatenate(out) if out else np.zeros(0, np.int32)), offsets_of(counts)

    def _merge_block(self, block: np.ndarray) -> list[np.ndarray]:
        n, width = block.shape
        sym = np.full((n, width + 1), -1, np.int32)
        sym[:, :width] = block
        if width < 2:
            return list(block)
        priority = np.full((n, width), _NONE, np.int32)
        priority[:, : width - 1] = self.find(sym[:, : width - 1].ravel(), sym[:, 1:width].ravel())[0].reshape(n, width - 1)
        length = np.full(n, width)
        live = np.arange(n)
        columns = np.arange(width + 1)
        while True:
            best = priority[live].argmin(1)
            keep = priority[live, best] != _NONE
            live, best = live[keep], best[keep]
            if not len(live):
                break
            _, joined = self.find(sym[live, best], sym[live, best + 1])
            pick = np.minimum(columns + (columns > best[:, None]), width)
            moved = np.take_along_axis(sym[live], pick, 1)
            moved[:, width] = -1
            rows = np.arange(len(live))
            moved[rows, best] = joined
            sym[live] = moved
            ranks = np.take_along_axis(priority[live], np.minimum(pick[:, :width], width - 1), 1)
            ranks[:, width - 1] = _NONE
            ranks[rows, best] = self.find(joined, moved[rows, best + 1])[0]
            before = np.flatnonzero(best > 0)
            ranks[before, best[before] - 1] = self.find(moved[before, best[before] - 1], joined[before])[0]
            priority[live] = ranks
            length[live] -= 1
        return [row[:k] for row, k in zip(sym, length.tolist(), strict=True)]

    def _merge_long(self, symbols: np.ndarray) -> np.ndarray:
        """One long sequence by a heap of pairs over a linked list: n log n."""
        sym, n = symbols.tolist(), len(symbols)
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        first = self.find(symbols[:-1], symbols[1:])
        heap = [(int(p), i, sym[i], sym[i + 1], int(m)) for i, (p, m) in enumerate(zip(*first, strict=True)) if p != _NONE]
        heapq.heapify(heap)
        one = lambda a, b: [int(x[0]) for x in self.find(np.array([a], np.int32), np.array([b], np.int32))]
        while heap:
            _, i, a, b, m = heapq.heappop(heap)
            j = nxt[i]
            if sym[i] != a or j >= n or sym[j] != b:
                continue
            sym[i], sym[j] = m, -1
            nxt[i] = nxt[j]
            if nxt[i] < n:
                prv[nxt[i]] = i
                p, q = one(m, sym[nxt[i]])
                if p != _NONE:
                    heapq.heappush(heap, (p, i, m, sym[nxt[i]], q))
            if prv[i] >= 0:
                p, q = one(sym[prv[i]], m)
                if p != _NONE:
                    heapq.heappush(heap, (p, prv[i], sym[prv[i]], m, q))
        return np.array([x for x in sym if x >= 0], np.int32)


class WordCache:
    """Ids of finished words, filled by ``encode`` for those not seen yet; emptied when it is full."""

    def __init__(self, encode, limit: int = 600_000):
        self.encode, self.limit = encode, limit
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.ids, self.used = np.zeros(1 << 16, np.int32), 0
        self.starts, self.lengths = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)

    def _add(self, words: list[str]) -> None:
        ids, offsets = self.encode(words)
        need, count = self.used + len(ids), len(self.index)
        if need > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(need, len(self.ids)), np.int32)])
        self.ids[self.used : need] = ids
        while count + len(words) > len(self.starts):
            self.starts, self.lengths = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.lengths))
        self.starts[count : count + len(words)] = offsets[:-1] + self.used
        self.lengths[count : count + len(words)] = np.diff(offsets)
        self.used = need
        self.index.update(zip(words, range(count, count + len(words)), strict=True))

    def lookup(self, words: list[str], inverse: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of ``words[inverse[0]], words[inverse[1]], ...`` on end, and each one's number of ids."""
        if len(self.index) + len(words) > self.limit:
            self.clear()
        get = self.index.get
        slot = [get(w, -1) for w in words]
        if missing := [w for w, s in zip(words, slot, strict=True) if s < 0]:
            self._add(missing)
            slot = [get(w) for w in words]
        at = np.array(slot, np.int64)[inverse] if words else np.zeros(0, np.int64)
        lengths = self.lengths[at]
        return self.ids[ragged(self.starts[at], lengths)], lengths
