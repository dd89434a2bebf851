"""Packing tokenised documents into sequences of a fixed length, best fit decreasing.

Documents longer than a sequence are first cut into full windows and a rest.
Pieces are then placed longest first, each in the open sequence with the least
room that still holds it.  All pieces of one length are alike, so the placement
is worked out over the counts per length (never more numbers than a sequence
has tokens): a segment tree over the remaining room finds the tightest open
sequences, and whole runs of sequences with equal room are filled at once.
Every piece then finds its place from its rank among the pieces of its length.
"""

from __future__ import annotations

import functools
import json
import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from ..session import materialize
from .common import binary, bytes_of, slices
from .merges import ROWS, PairTable, Recent, WordTable, merge_rows, merged

WINDOW = 2048
SLICES = 256  # parts into which the ranking of one length is split
CACHE_ENTRIES = 400_000
CACHED_CHARS = 48
MARKS = ".,!?;:*%#$&"
LATIN1_END = "\u0100"
BLOCK = 1 << 20  # bytes of text looked at in one go
TABLE_ENTRIES = BLOCK
SHORT, LONG = 16, 256  # bytes: the longest part of a word that is merged with many others, and the longest such word
BLANK, LETTER, MARK, DIGIT, OTHER = range(5)
KINDS = np.full(256, OTHER, np.uint8)
KINDS[33:127] = MARK
KINDS[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"]] = LETTER
KINDS[[*b"0123456789"]] = DIGIT
KINDS[[*b" \n"]] = BLANK
KINDS[[*b"'<"]] = OTHER  # may begin 's or <|endoftext|>
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32
FIRST_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


class WordTokens:
    """Token ids by words between blanks and line ends: no token of this vocabulary reaches over white space.

    Words of Latin letters, digits and ASCII marks are cut into their runs of
    letters, runs of marks and single digits, as the tokenizer cuts them, and the
    parts are looked up and merged many at a time.  Words with anything else, an
    apostrophe or a ``<`` in them, and long ones are looked up whole; those of
    Latin letters with marks behind them are merged here, others go to the
    tokenizer itself, which also finds its special tokens in them (their strings
    hold no white space).
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words = Recent(CACHE_ENTRIES, CACHED_CHARS)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        pairs = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        joined = np.array([vocab[a + b] for a, b in pairs], np.int32)
        if (np.diff(joined) <= 0).any():
            raise ValueError("merged ids must ascend with the order of the merges")
        self.pairs = PairTable(np.array([vocab[a] for a, _ in pairs], np.int32), np.array([vocab[b] for _, b in pairs], np.int32), joined)
        # the character that stands for each byte
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
        hidden = [b for b in range(256) if b not in set(shown)]
        sign = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}
        self.inner = np.array([vocab[sign[b]] for b in range(256)], np.int32)
        self.last = np.array([vocab[sign[b] + end] for b in range(256)], np.int32)
        self.parts = WordTable(TABLE_ENTRIES, self._merge_parts)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed little-endian unsigned 32-bit ids of every text."""
        ids, ends = self.encode_column(pa.array(texts, pa.string()))
        return [ids[a:b].tobytes() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array of little-endian unsigned 32-bit numbers, and where each text starts (one more entry than texts)."""
        raw, offsets = bytes_of(binary(texts))
        out, starts, total, a = [], np.zeros(len(offsets), np.int64), 0, 0
        while a < len(raw):
            b = self._block_end(raw, offsets, a)
            docs = slice(*np.searchsorted(offsets, [a, b]))
            ids, begin, before = self._encode_block(raw[a:b], offsets[docs] - a)
            starts[docs] = total + before[np.searchsorted(begin, offsets[docs] - a)]
            out.append(ids)
            total, a = total + len(ids), b
        starts[np.searchsorted(offsets, len(raw)):] = total
        return np.concatenate(out) if out else np.zeros(0, "<u4"), starts

    @staticmethod
    def _block_end(raw: np.ndarray, offsets: np.ndarray, a: int) -> int:
        """Where a block from ``a`` ends: behind a blank or a text, about BLOCK bytes on; later only if a word is longer."""
        if len(raw) - a <= BLOCK:
            return len(raw)
        text = int(offsets[np.searchsorted(offsets, a + BLOCK, "right") - 1])  # the last text that starts in reach
        blank = np.flatnonzero(KINDS[raw[max(a, a + BLOCK - 2 * LONG):a + BLOCK]] == BLANK)
        if len(blank):
            return max(a, a + BLOCK - 2 * LONG) + int(blank[-1]) + 1
        if text > a:
            return text
        end, b = int(offsets[np.searchsorted(offsets, a, "right")]), a
        while b < end:
            blank = np.flatnonzero(KINDS[raw[b:min(b + BLOCK, end)]] == BLANK)
            if len(blank):
                return b + int(blank[0 if b > a else -1]) + 1
            b += BLOCK
        return end

    def _encode_block(self, raw: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of some bytes that cut no word; where each word or part of one starts, and how many ids lie before it (one more entry)."""
        begin, end, whole, lower = self._cut(raw, texts)
        start, size = np.empty(len(begin), np.int64), np.empty(len(begin), np.int64)
        short = np.flatnonzero(~whole) if whole.any() else slice(None)
        padded = np.concatenate([lower, np.zeros(SHORT, np.uint8)])
        eight = np.ndarray(len(lower) + 9, "<u8", padded, strides=(1,))  # the eight bytes from each byte on
        at, length = begin[short], (end - begin)[short]
        low = eight[at] & FIRST_BYTES[np.minimum(length, 8)]
        high = eight[at + 8] & FIRST_BYTES[np.maximum(length - 8, 0)]
        start[short], size[short] = self.parts.runs(low, high)
        if whole.any():
            data = raw.tobytes()
            words = [data[a:b].decode() for a, b in zip(begin[whole].tolist(), end[whole].tolist())]
            known = self.words.of(set(words), self._encode_words)
            packed = [known[w] for w in words]
            size[whole] = n = np.array([len(p) // 4 for p in packed])
            start[whole] = self.parts.place(self.parts.held + 1, np.frombuffer(b"".join(packed), "<u4")) + np.cumsum(n) - n
        before = np.zeros(len(begin) + 1, np.int64)
        np.cumsum(size, out=before[1:])
        ids = self.parts.ids[np.repeat(start - before[:-1], size) + np.arange(before[-1])]
        return ids.astype("<u4"), begin, before

    @staticmethod
    def _cut(raw: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of what is looked up, whether it is a whole word, and the bytes with Latin letters in lower case."""
        kind, lower = KINDS[raw], LOWER[raw]
        lead = np.flatnonzero(raw[:-1] == 0xC3)
        behind = raw[lead + 1]
        latin = (behind & 0xC0 == 0x80) & (behind & 0xDF != 0x97)  # U+00C0 to U+00FF without the signs for times and division
        lead, behind = lead[latin], behind[latin]
        kind[lead] = kind[lead + 1] = LETTER
        lower[lead + 1] += np.where(behind < 0x9F, np.uint8(32), np.uint8(0))
        text = np.zeros(len(raw), bool)
        text[texts] = True
        run = kind == DIGIT
        run |= text
        run[:1] = True
        run[1:] |= kind[1:] != kind[:-1]
        begin = np.flatnonzero(run)
        end = np.append(begin[1:], len(raw))
        kinds = kind[begin]
        first = text[begin]  # of a word
        first[:1] = True
        first[1:] |= kinds[:-1] == BLANK
        solid = kinds != BLANK
        begin, end, kinds, first = begin[solid], end[solid], kinds[solid], first[solid]
        if not len(begin):
            return begin, end, first, lower
        word = np.cumsum(first) - 1
        word_end = end[np.append(np.flatnonzero(first)[1:] - 1, len(end) - 1)]
        whole = word_end - begin[first] > LONG
        whole[word[(kinds == OTHER) | (end - begin > SHORT)]] = True
        whole = whole[word]
        kept = first | ~whole
        begin, end, word, whole = begin[kept], end[kept], word[kept], whole[kept]
        end[whole] = word_end[word[whole]]
        return begin, end, whole, lower

    def _merge_parts(self, parts: np.ndarray) -> np.ndarray:
        """Ids of parts of words, each given as two numbers, padded with -1."""
        byte = parts.astype("<u8").view(np.uint8)
        size = (byte != 0).sum(axis=1)
        out, place = np.full((len(parts), SHORT), -1, np.int32), np.arange(SHORT)
        for width in range(2, SHORT + 1, 2):
            rows = np.flatnonzero((size == width) | (size == width - 1))
            for a in range(0, len(rows), ROWS):
                part = rows[a:a + ROWS]
                b, last, at = byte[part, :width], size[part, None] - 1, place[:width]
                out[part, :width] = merged(np.where(at < last, self.inner[b], np.where(at == last, self.last[b], np.int32(-1))), self.pairs)
        return out

    def _encode_words(self, words: list[str]) -> list[bytes]:
        plain, other = [], []
        for k, w in enumerate(words):
            core = w.rstrip(MARKS)
            if core.isalpha() and max(core) < LATIN1_END and len(w) <= 48:
                plain.append((k, core.lower(), w[len(core):]))
            else:
                other.append(k)
        out: list[bytes] = [b""] * len(words)
        merged = self._merge(list({x for _, core, marks in plain for x in (core, marks) if x}))
        for k, core, marks in plain:
            out[k] = merged[core] + merged[marks] if marks else merged[core]
        for k, e in zip(other, self.tokenizer.encode_batch_fast([words[k] for k in other], add_special_tokens=False)):
            out[k] = np.array(e.ids, "<u4").tobytes()
        return out

    def _merge(self, words: list[str]) -> dict[str, bytes]:
        raw, by_width, out = [w.encode() for w in words], {}, {}
        for k, b in enumerate(raw):
            by_width.setdefault(-(-len(b) // 2) * 2, []).append(k)
        for width, rows in by_width.items():
            for a in range(0, len(rows), ROWS):
                part = rows[a:a + ROWS]
                size = np.array([len(raw[k]) for k in part])[:, None]
                byte = np.frombuffer(b"".join(raw[k].ljust(width, b"\0") for k in part), np.uint8).reshape(-1, width)
                place = np.arange(width)
                ids = np.where(place < size - 1, self.inner[byte], np.where(place == size - 1, self.last[byte], np.int32(-1)))
                out.update(zip([words[k] for k in part], merge_rows(ids, self.pairs)))
        return out


@functools.lru_cache(maxsize=2)
def word_tokens(path: str) -> WordTokens:
    return WordTokens(path)


def pieces(docs: DataFrame, tokenizer: str, end_id: int = 1, window: int = WINDOW, key: str = "doc_id", text: str = "text",
           with_ids: bool = False) -> DataFrame:
    """Tokenises documents and cuts them: key, start, length, ids_crc32, doc_tokens and, if asked for, the packed ids.

    Each document ends with ``end_id``, so a null or empty text is one piece of
    one token.  All pieces but the last are full windows.  Equal rows give equal
    pieces; other columns are dropped.
    """
    schema = T.StructType([docs.schema[key], *[T.StructField(c, T.LongType(), False) for c in ("start", "length", "ids_crc32", "doc_tokens")],
                           *([T.StructField("ids", T.BinaryType(), False)] if with_ids else [])])
    end = int(end_id).to_bytes(4, "little")

    def run(batches):
        words = word_tokens(tokenizer)
        for whole in batches:
            for part in slices(whole, text):
                row, start, length, crc, total, ids = [], [], [], [], [], []
                every, ends = words.encode_column(part.column(text))
                for i, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())):
                    packed = every[a:b].tobytes() + end
                    n = len(packed) // 4
                    for a in range(0, n, window):
                        piece = packed[4 * a:4 * (a + window)]
                        row.append(i), start.append(a), length.append(len(piece) // 4), crc.append(zlib.crc32(piece)), total.append(n)
                        if with_ids:
                            ids.append(piece)
                columns = [part.column(key).take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))]
                yield pa.RecordBatch.from_arrays([*columns, *([pa.array(ids, pa.binary())] if with_ids else [])], names=schema.names)

    return docs.select(key, text).mapInArrow(run, schema)


class RoomTree:
    """Segment tree over the remaining room: how many runs of open sequences have exactly that room."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, room: int, by: int) -> None:
        i = room + self.leaves
        while i:
            self.count[i] += by
            i >>= 1

    def tightest(self, need: int) -> int:
        """The least room of at least ``need`` that some run has, or -1."""
        i = need + self.leaves
        if self.count[i]:
            return need
        while i > 1:
            if not i & 1 and self.count[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.count[2 * i] else 2 * i + 1
                return i - self.leaves
            i >>= 1
        return -1


def best_fit_decreasing(counts: dict[int, int], window: int = WINDOW) -> np.ndarray:
    """Places for all pieces, given how many there are of each length.

    Rows (length, first rank, first sequence, pieces per sequence, offset):
    piece ``first rank + k`` of that length goes to sequence ``first sequence +
    k // pieces per sequence``, ``k % pieces per sequence`` lengths after the offset.
    """
    tree, runs, places, opened = RoomTree(window), {}, [], 0

    def open_run(room: int, first: int, n: int) -> None:
        if room and n:
            runs.setdefault(room, []).append((first, n))
            tree.add(room, 1)

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = tree.tightest(length)
            if room < 0:
                room, n = window, -(-left // (window // length))
                first, opened = opened, opened + n
            else:
                first, n = runs[room].pop(0)
                tree.add(room, -1)
            each = room // length  # a sequence stays the tightest one until nothing more fits
            used = min(n, -(-left // each))
            placed = min(left, used * each)
            places.append((length, rank, first, each, window - room))
            whole, rest = divmod(placed, each)
            open_run(room - each * length, first, whole)
            if rest:
                open_run(room - rest * length, first + whole, 1)
            open_run(room, first + used, n - used)
            rank, left = rank + placed, left - placed
    return np.array(places, np.int64).reshape(-1, 5)


def pack(pieces: DataFrame, window: int = WINDOW, key: str = "doc_id") -> DataFrame:
    """Adds sequence_id and offset to a stored table of pieces.

    The driver gets one count per length and slice (at most window x SLICES
    numbers).  The ranking is a window per length and slice, so a length that
    most pieces share is spread as well.  Ties are ordered by key, start and crc.
    """
    sliced = pieces.withColumn("_slice", F.pmod(F.xxhash64(key, "start", "ids_crc32"), F.lit(SLICES)))
    before = np.zeros((window + 1, SLICES), np.int64)
    for r in sliced.groupBy("length", "_slice").count().toLocalIterator():
        before[r["length"], r["_slice"]] = r["count"]
    counts = before.sum(axis=1)
    places = best_fit_decreasing({int(n): int(counts[n]) for n in np.flatnonzero(counts)}, window)
    before = np.cumsum(before, axis=1) - before
    ranked = sliced.withColumn("_rank", F.row_number().over(W.partitionBy("length", "_slice").orderBy(key, "start", "ids_crc32")))
    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType(), False), T.StructField("offset", T.LongType(), False)])
    kept = pieces.columns
    keys = places[:, 0] * np.int64(1 << 40) + places[:, 1]
    order = np.argsort(keys)
    keys, places = keys[order], places[order]

    def run(batches):
        for b in batches:
            length, part = b.column("length").to_numpy(), b.column("_slice").to_numpy()
            rank = before[length, part] + b.column("_rank").to_numpy() - 1
            at = places[np.searchsorted(keys, length * np.int64(1 << 40) + rank, "right") - 1]
            k = rank - at[:, 1]
            yield pa.RecordBatch.from_arrays(
                [*[b.column(c) for c in kept], pa.array(at[:, 2] + k // at[:, 3]), pa.array(at[:, 4] + k % at[:, 3] * length)],
                names=schema.names)

    return ranked.mapInArrow(run, schema)


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, window: int = WINDOW, key: str = "doc_id", text: str = "text",
                   with_ids: bool = False) -> DataFrame:
    return pack(materialize(pieces(docs, tokenizer, end_id, window, key, text, with_ids), "pieces"), window, key)
