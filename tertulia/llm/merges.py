"""Byte-pair merging of many short symbol rows at once."""

from __future__ import annotations

import numpy as np

NONE = np.int32(2**31 - 1)
ROWS = 8192


class PairTable:
    """Open addressing from a pair of ids to the id of their joined bytes."""

    def __init__(self, left: np.ndarray, right: np.ndarray, joined: np.ndarray):
        self.mask = np.int64((1 << max(4, int(4 * len(left)).bit_length())) - 1)
        self.keys = np.full(int(self.mask) + 1, -1, np.int64)
        self.values = np.full(int(self.mask) + 1, NONE, np.int32)
        key, value = (left.astype(np.int64) << 32) | right, joined
        slot = self._slot(key)
        while len(key):
            _, first = np.unique(slot, return_index=True)
            first = first[self.keys[slot[first]] < 0]
            self.keys[slot[first]], self.values[slot[first]] = key[first], value[first]
            rest = np.ones(len(key), bool)
            rest[first] = False
            key, value, slot = key[rest], value[rest], (slot[rest] + 1) & self.mask

    def _slot(self, key: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((key ^ (key >> 29)) * np.int64(0x2545F4914F6CDD1D) >> 20) & self.mask

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left.astype(np.int64) << 32) | right.astype(np.int64)
        out = np.full(key.shape, NONE, np.int32)
        at = np.flatnonzero((left.ravel() >= 0) & (right.ravel() >= 0))
        flat, key = out.ravel(), key.ravel()[at]
        slot = self._slot(key)
        while len(at):
            found = self.keys[slot]
            hit = found == key
            flat[at[hit]] = self.values[slot[hit]]
            on = ~hit & (found >= 0)
            at, key, slot = at[on], key[on], (slot[on] + 1) & self.mask
        return flat.reshape(out.shape)


def merged(ids: np.ndarray, pairs: PairTable) -> np.ndarray:
    """Merges rows of symbol ids, padded with -1, until no pair is left; the ids of each row, padded again.

    Joined ids must be ranks too: the pair with the least joined id goes first,
    of equal ones the leftmost.
    """
    done, row = np.full(ids.shape, -1, np.int32), np.arange(len(ids))
    rank = np.full(ids.shape, NONE, np.int32)
    rank[:, :-1] = pairs.get(ids[:, :-1], ids[:, 1:])
    while len(row):
        j = rank.argmin(axis=1)
        least = rank[np.arange(len(row)), j]
        on = least < NONE
        if not on.all():
            done[row[~on], : ids.shape[1]] = ids[~on]
            row, ids, rank, j, least = row[on], ids[on], rank[on], j[on], least[on]
            if not len(row):
                break
        # every row loses one symbol, so the matrix loses a column
        at, width = np.arange(len(row)), ids.shape[1] - 1
        ids[at, j] = least
        keep = np.ones(ids.shape, bool)
        keep[at, j + 1] = False
        ids, rank = ids[keep].reshape(-1, width), rank[keep].reshape(-1, width)
        rank[:, -1] = NONE
        has = np.flatnonzero(j + 1 < width)
        rank[has, j[has]] = pairs.get(ids[has, j[has]], ids[has, j[has] + 1])
        has = np.flatnonzero(j > 0)
        rank[has, j[has] - 1] = pairs.get(ids[has, j[has] - 1], ids[has, j[has]])
    return done


def merge_rows(ids: np.ndarray, pairs: PairTable) -> list[bytes]:
    """Packed ids of each merged row."""
    done = merged(ids, pairs)
    size = (done >= 0).sum(axis=1) * 4
    flat = done[done >= 0].astype("<u4").tobytes()
    ends = np.cumsum(size).tolist()
    return [flat[e - n:e] for e, n in zip(ends, size.tolist())]


class WordTable:
    """Runs of ids by words of 1 to 16 bytes without zero bytes, each word given as two numbers (its bytes, zeros behind them).

    Open addressing finds the number of a word; numbers rise as words are met,
    so what is frequent lies close together.  ``merge(words)`` gives the ids of
    unknown words, padded with -1.  When ``entries`` words are held, all go.
    """

    def __init__(self, entries: int, merge):
        self.entries, self.merge = entries, merge
        self.mask = np.uint64((1 << (2 * entries - 1).bit_length()) - 1)
        self.clear()

    def clear(self) -> None:
        self.held = 0  # number 0 is no word
        self.number = np.zeros(int(self.mask) + 1, np.int32)
        self.low, self.high = np.zeros(self.entries + 1, np.uint64), np.zeros(self.entries + 1, np.uint64)
        self.start = np.zeros(self.entries + 2, np.int64)
        self.ids = np.zeros(4096, np.int32)

    def _slot(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        h = (low ^ (high * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93)
        return (h ^ (h >> np.uint64(32))) & self.mask

    def _find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Numbers of words, 0 for unknown ones."""
        slot = self._slot(low, high)
        out = self.number[slot]
        at = np.flatnonzero((out != 0) & ((self.low[out] != low) | (self.high[out] != high)))
        while len(at):
            slot[at] = (slot[at] + np.uint64(1)) & self.mask
            k = out[at] = self.number[slot[at]]
            at = at[(k != 0) & ((self.low[k] != low[at]) | (self.high[k] != high[at]))]
        return out

    def _insert(self, low: np.ndarray, high: np.ndarray) -> None:
        ids = self.merge(np.stack([low, high], axis=1))
        first, last = self.held + 1, self.held + len(low)
        self.held, self.low[first:last + 1], self.high[first:last + 1] = last, low, high
        self.start[first + 1:last + 2] = self.start[first] + np.cumsum((ids >= 0).sum(axis=1))
        self.place(first, ids[ids >= 0])
        slot, number = self._slot(low, high), np.arange(first, last + 1, dtype=np.int32)
        while len(number):
            free = np.flatnonzero(self.number[slot] == 0)
            self.number[slot[free]] = number[free]  # of several words for a slot one stays
            on = self.number[slot] != number
            slot, number = (slot[on] + np.uint64(1)) & self.mask, number[on]

    def place(self, number: int, ids: np.ndarray) -> int:
        """Writes ids where those of a word of this number start; the place.  Behind the last word they stay until the next call."""
        start = int(self.start[number])
        if start + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids[:start], np.zeros(start + 2 * len(ids) + 4096, np.int32)])
        self.ids[start:start + len(ids)] = ids
        return start

    def runs(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of each word start in ``ids``, and how many they are; at most ``entries`` words at once."""
        k = self._find(low, high)
        new = np.flatnonzero(k == 0)
        if len(new):
            if self.held + len(new) > self.entries:
                self.clear()
                new = np.arange(len(low))
            order = new[np.lexsort((high[new], low[new]))]
            a, b = low[order], high[order]
            once = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
            self._insert(a[once], b[once])
            k[new] = self._find(low[new], high[new])
        start = self.start[k]
        return start, self.start[k + 1] - start


class Recent:
    """What was made for keys lately; of two generations the older one goes when the younger is full."""

    def __init__(self, entries: int, longest: int):
        self.entries, self.longest, self.old, self.new = entries, longest, {}, {}

    def of(self, keys: set, make) -> dict:
        """A table with a value for each of the keys; ``make(list of keys)`` gives the missing ones."""
        if len(self.new) > self.entries:
            self.old, self.new = self.new, {}
        missing = keys - self.new.keys()
        again = missing & self.old.keys()
        self.new.update((k, self.old[k]) for k in again)
        fresh = list(missing - again)
        made = make(fresh)
        long = [(k, v) for k, v in zip(fresh, made) if len(k) > self.longest]
        if not long:
            self.new.update(zip(fresh, made))
            return self.new
        self.new.update((k, v) for k, v in zip(fresh, made) if len(k) <= self.longest)
        return {**self.new, **dict(long)}
