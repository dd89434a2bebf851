"""Byte-level BPE: encoding and decoding with a file of ranks.

Texts are cut into pre-tokens by a pattern.  Pre-tokens not met before are put
into padded matrices of similar length; every round merges the leftmost pair of
least rank of every row, looking pairs up in a hashed table, and closes the gap.
Rows without a pair to merge leave the matrix.

Null texts count as empty and have no ids.  Ids are handed on as packed
little-endian unsigned 32-bit integers.
"""

from __future__ import annotations

import base64
import functools
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from .common import binary, slices
from .merges import ROWS, PairTable, Recent, merge_rows

CACHE_ENTRIES = 120_000  # pre-tokens a worker remembers
CACHED_CHARS = 64  # longer pre-tokens are not kept
MARKS = ".,!?;:*%#$&"  # a run of these is one pre-token
LATIN_END = "\u0250"  # letters before it are letters in every version of Unicode
OTHER_SPACE = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]  # U+3000 is the last of all
MATRIX_BYTES = 64  # longer pre-tokens are merged one by one with a heap


class BytePairs:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.bytes_of[i] = token
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = [(ranks[t[:k]], ranks[t[k:]], i) for t, i in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        self.pairs = PairTable(*(np.array(c, np.int32) for c in zip(*pairs))) if pairs else None

    def encode(self, tokens: list[bytes]) -> list[bytes]:
        """Packed ids of every pre-token."""
        out: list[bytes] = [b""] * len(tokens)
        by_width: dict[int, list[int]] = {}
        for k, t in enumerate(tokens):
            if (i := self.ranks.get(t)) is not None:
                out[k] = i.to_bytes(4, "little")
            elif len(t) > MATRIX_BYTES or self.pairs is None:
                out[k] = self._merge_long(t)
            elif t:
                by_width.setdefault(-(-len(t) // 2) * 2, []).append(k)
        for width, rows in by_width.items():
            for a in range(0, len(rows), ROWS):
                part = rows[a:a + ROWS]
                for k, ids in zip(part, self._merge_rows([tokens[k] for k in part], width)):
                    out[k] = ids
        return out

    def _merge_rows(self, tokens: list[bytes], width: int) -> list[bytes]:
        raw = np.frombuffer(b"".join(t.ljust(width, b"\0") for t in tokens), np.uint8).reshape(len(tokens), width)
        size = np.array([len(t) for t in tokens])
        return merge_rows(np.where(np.arange(width) < size[:, None], self.single[raw], np.int32(-1)), self.pairs)

    def _merge_long(self, token: bytes) -> bytes:
        """One long pre-token: a heap of (rank, place) gives the leftmost pair of least rank."""
        piece = [token[i:i + 1] for i in range(len(token))]
        left, right = list(range(-1, len(piece) - 1)), [*range(1, len(piece)), -1]
        get = self.ranks.get
        heap = [(r, i) for i in range(len(piece) - 1) if (r := get(piece[i] + piece[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            if not piece[i] or (k := right[i]) < 0 or get(piece[i] + piece[k]) != r:
                continue
            piece[i], piece[k] = piece[i] + piece[k], b""
            right[i] = right[k]
            if right[k] >= 0:
                left[right[k]] = i
            for a, b in ((left[i], i), (i, right[i])):
                if a >= 0 and b >= 0 and (s := get(piece[a] + piece[b])) is not None:
                    heapq.heappush(heap, (s, a))
        return np.array([get(p) for p in piece if p], "<u4").tobytes()


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class TextEncoder:
    """Encodes texts; one of these lives in every Python worker."""

    def __init__(self, path: str, pattern: str):
        import regex

        self.bpe, self.find = BytePairs(read_ranks(path)), regex.compile(pattern).findall
        self.words = Recent(CACHE_ENTRIES, CACHED_CHARS)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Chunks end before single blanks between other characters, where every pre-token ends too."""
        chunks = []
        for t in texts:
            # all white space is single blanks and line ends
            if len(t.split()) == t.count(" ") + t.count("\n") + 1 and not any(c in t for c in OTHER_SPACE):
                first, *rest = t.split(" ")
                chunks.append([first, *[" " + x for x in rest]])
            else:
                chunks.append(self.find(t))
        known = self.words.of({c for cs in chunks for c in cs}, self._encode_chunks)
        return [b"".join(map(known.__getitem__, cs)) for cs in chunks]

    def _encode_chunks(self, chunks: list[str]) -> list[bytes]:
        parts = []
        for c in chunks:
            core = c.rstrip(MARKS)
            letters = core[1:] if core[:1] == " " else core
            if letters.isalpha() and max(letters) < LATIN_END:
                parts.append((core, c[len(core):]) if len(core) < len(c) else (core,))
            else:
                parts.append(self.find(c))
        distinct = list({p for ps in parts for p in ps})
        made = dict(zip(distinct, self.bpe.encode([p.encode("utf-8", "surrogatepass") for p in distinct])))
        return [made[ps[0]] if len(ps) == 1 else b"".join([made[p] for p in ps]) for ps in parts]


@functools.lru_cache(maxsize=2)
def text_encoder(path: str, pattern: str) -> TextEncoder:
    return TextEncoder(path, pattern)


@functools.lru_cache(maxsize=2)
def token_bytes(path: str) -> list[bytes]:
    return BytePairs(read_ranks(path)).bytes_of


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Replaces the column ``text`` by ``ids`` (binary: packed little-endian unsigned 32-bit ids).

    Narrow: no shuffle, a bounded number of bytes of text in memory.  A null
    text gives empty ids, an empty table an empty table; a column that bears
    the name of ``ids`` already is replaced.
    """
    keep = [c for c in df.columns if c not in (text, ids)]
    schema = T.StructType([*[df.schema[c] for c in keep], T.StructField(ids, T.BinaryType(), False)])

    def run(batches):
        encoder = text_encoder(path, pattern)
        for whole in batches:
            for part in slices(whole, text):
                packed = encoder.encode([t or "" for t in part.column(text).to_pylist()])
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], pa.array(packed, pa.binary())], names=[*keep, ids])

    return df.select(*keep, text).mapInArrow(run, schema)


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds ``out`` (binary): the bytes that the packed ids stand for; null ids give no bytes."""
    keep = [c for c in df.columns if c != out]
    schema = T.StructType([*[df.schema[c] for c in keep], T.StructField(out, T.BinaryType(), False)])

    def run(batches):
        get = token_bytes(path).__getitem__
        for whole in batches:
            for part in slices(whole, ids):
                rows = [b"".join(map(get, np.frombuffer(p, "<u4").tolist())) for p in binary(part.column(ids)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], pa.array(rows, pa.binary())], names=[*keep, out])

    return df.select(*keep).mapInArrow(run, schema)
