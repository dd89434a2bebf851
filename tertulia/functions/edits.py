"""Edit distances of many pairs of texts at once.

The bit-parallel algorithm of Myers: 64 rows of the distance matrix are one word,
a column is one step.  The words of a text follow each other by one column, so
that a step works on all words of all pairs of a batch together.
"""

from __future__ import annotations

import numpy as np

WORDS_PER_STEP = 4096  # words of a batch, which stay in a core's cache
TABLE_WORDS = 1 << 21  # words of a batch's table of places, and signs of its texts
_SIGNS = 0x110000


def _distances(short: list[np.ndarray], long: list[np.ndarray], number: np.ndarray) -> np.ndarray:
    """Distances of a batch; `number` is zero at every sign, and is left so."""
    m, n = np.array([len(x) for x in short]), np.array([len(x) for x in long])
    pairs, words, columns = len(m), -(-int(m.max()) // 64), int(n.max())
    signs, of = np.concatenate(short), np.repeat(np.arange(pairs), m)
    at = np.arange(len(signs)) - np.repeat(np.cumsum(m) - m, m)
    used = np.unique(signs)
    number[used] = np.arange(1, len(used) + 1)
    places = np.zeros((len(used) + 1) * words * pairs, np.uint64)  # by sign, word, pair; sign 0 is found nowhere
    np.bitwise_or.at(places, (number[signs] * words + (at >> 6)) * pairs + of, np.uint64(1) << (at & 63).astype(np.uint64))
    # texts end together: the columns before them change nothing
    text = np.zeros((columns + 2 * (words - 1), pairs), np.int64)
    begun = np.zeros((columns + words - 1, pairs), np.uint64)
    for k, x in enumerate(long):
        text[words - 1 + columns - len(x):words - 1 + columns, k] = number[x]
        begun[columns - len(x):columns, k] = 1
    number[used] = 0
    text *= words * pairs
    base = np.arange(words * pairs).reshape(words, pairs)
    new = lambda fill=0: np.full((words, pairs), fill, np.uint64)
    up, down, up_in, down_in = new(~np.uint64(0)), new(), new(), new()  # differences along a column; those that come in from the word before
    eq, xv, xh, ph, mh, last_up, last_down, where = new(), new(), new(), new(), new(), new(), new(), np.empty((words, pairs), np.int64)
    one, top = np.uint64(1), np.uint64(63)
    for t in range(columns + words - 1):
        up_in[0] = begun[t]
        np.add(text[t:t + words][::-1], base, out=where)
        np.take(places, where, out=eq, mode="clip")
        np.bitwise_or(eq, down, out=xv)
        np.bitwise_or(eq, down_in, out=eq)
        np.bitwise_and(eq, up, out=xh)
        np.add(xh, up, out=xh)
        np.bitwise_xor(xh, up, out=xh)
        np.bitwise_or(xh, eq, out=xh)
        np.bitwise_or(xh, up, out=ph)
        np.invert(ph, out=ph)
        np.bitwise_or(ph, down, out=ph)
        np.bitwise_and(up, xh, out=mh)
        np.left_shift(ph, one, out=xh)
        np.bitwise_or(xh, up_in, out=xh)
        np.left_shift(mh, one, out=eq)
        np.bitwise_or(eq, down_in, out=eq)
        np.right_shift(ph[:-1], top, out=up_in[1:])
        np.right_shift(mh[:-1], top, out=down_in[1:])
        np.bitwise_or(xv, xh, out=up)
        np.invert(up, out=up)
        np.bitwise_or(up, eq, out=up)
        np.bitwise_and(xh, xv, out=down)
        if t >= columns - 1:  # word w has met its last column
            w = t - columns + 1
            last_up[w], last_down[w] = up[w], down[w]
    room = np.clip(m[None] - 64 * np.arange(words)[:, None], 0, 64)
    mask = np.where(room == 64, ~np.uint64(0), (np.uint64(1) << np.minimum(room, 63).astype(np.uint64)) - np.uint64(1))
    bits = lambda x: np.bitwise_count(x & mask).sum(0, dtype=np.int64)
    return n + bits(last_up) - bits(last_down)


def edit_distances(a: list[str], b: list[str]) -> np.ndarray:
    """Levenshtein distance of a[i] and b[i], in code points."""
    codes = [[np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32) for s in side] for side in (a, b)]
    pairs = [(x, y) if len(x) <= len(y) else (y, x) for x, y in zip(*codes)]
    out = np.array([len(y) for _, y in pairs], np.int64)
    size = [(-(-len(x) // 64), len(y)) for x, y in pairs]
    number, batch, signs = np.zeros(_SIGNS, np.int64), [], set()

    def settle():
        if batch:
            out[batch] = _distances(*zip(*[pairs[i] for i in batch]), number)
            batch.clear()
            signs.clear()

    for i in sorted((i for i in range(len(pairs)) if size[i][0]), key=size.__getitem__):
        words, columns = size[i]
        own = set(np.unique(pairs[i][0]).tolist())
        n = len(batch) + 1
        if n * words > WORDS_PER_STEP or n * (columns + 2 * words) > TABLE_WORDS or (len(signs | own) + 1) * words * n > TABLE_WORDS:
            settle()
        batch.append(i)
        signs |= own
    settle()
    return out
