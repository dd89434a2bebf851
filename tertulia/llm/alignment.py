"""Alignment of two tokenizers over a corpus, with external counting of linked ids.

Each text is encoded by a byte-level BPE (A, with a blank in front) and a
sentence-piece model (B, which puts that blank itself).  Byte places where
tokens of both end cut them into groups; an A and a B token whose bytes overlap
are linked.  A pair of ids counts in how many documents it is linked, and a
link is best if its count is the highest that its A id has anywhere.

1. ``encode`` (narrow).  A task aligns its documents by sorted searches over the
   token ends of many texts at once and gathers records (pair, document,
   occurrences).  After about ``RUN_RECORDS`` of them it writes a run: records
   are radix-partitioned by A id, sorted A-major (all pairs of an A id together)
   and compressed; beside them lies the run's short list of pairs with the
   number of documents that hold each.
2. ``merge``.  Lists of up to ``FAN`` runs of a partition are merged by a heap
   over their heads, adding up counts, level by level until there is one list
   per partition.  Only one block per list is open at a time, and a list has one
   entry per pair however many documents hold it, so a pair that a third of all
   documents share is one entry per run.
3. In the last merge all pairs of an A id come one after the other, so its
   highest count is known when the id ends.  Counts and marks of the best go
   back down the levels (``descend``), to each list in its own order.
4. ``contribute``.  Each run gets the answers for its pairs, adds them up over
   its records and writes its documents' results.

Texts are encoded word by word, cut at single blanks between other characters,
where tokens of both end whatever stands around; a task remembers the words it
met lately.  A very long text is taken in stretches.  Strings of special tokens
inside texts are plain text.

A null or empty text, and a text whose joined token bytes of A or B differ from
the blank and the text, has no tokens: zeros and an empty digest.  Every row is
a document, also if its id is null or repeated.  Extra columns are dropped
whatever their names; empty tables give empty results.
"""

from __future__ import annotations

import array
import functools
import hashlib
import heapq
import itertools
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F, types as T

from ..session import materialize
from .common import neighbours, slices, small_batches
from .merges import Recent

RADIX = 64  # partitions of A ids
RUN_RECORDS = 1_500_000
FAN = 64  # lists merged at once
BLOCK = 1 << 16  # entries of a list compressed together
SLICE_BYTES = 1 << 19
STRETCH = 1 << 16  # characters of a text taken at once
PARTS = 512  # stretches looked up together
CACHE_ENTRIES = 120_000  # words a worker remembers
CACHED_CHARS = 48  # longer ones are not kept
_BLANK = re.compile(r"(?<=\S) (?=\S)")


def squeeze(values: np.ndarray) -> bytes:
    """Whole numbers, byte plane by byte plane, compressed."""
    values = np.ascontiguousarray(values)
    planes = values.view(np.uint8).reshape(len(values), values.itemsize).T
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(planes).tobytes())


def expand(raw: bytes, kind: str) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(planes.reshape(width, -1).T).view(kind).ravel()


def steps(values: np.ndarray) -> np.ndarray:
    """Differences of unsigned numbers, modulo their range; the first value as it is."""
    return np.diff(values, prepend=values.dtype.type(0))


def from_steps(raw: bytes, kind: str) -> np.ndarray:
    found = expand(raw, kind)
    return np.cumsum(found, dtype=found.dtype)


class Aligner:
    """Two tokenizers, the bytes of their tokens, and the alignment of batches of texts."""

    def __init__(self, a_path: str, b_path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a_bytes, self.b_bytes = self._byte_level(), self._pieces()
        self.a_size, self.b_size = (np.array([len(t) for t in x], np.int64) for x in (self.a_bytes, self.b_bytes))
        self.rows = -(-len(self.a_bytes) // RADIX)  # A ids of a partition
        self.whole = all("▁" not in p.lstrip("▁") for p in map(self.b.id_to_piece, range(len(self.b_bytes))))
        self.words = Recent(CACHE_ENTRIES, CACHED_CHARS)
        self.a_digits, self.b_digits = (self._digits(len(x)) for x in (self.a_bytes, self.b_bytes))

    def _byte_level(self) -> list[bytes]:
        """Bytes of A's tokens: printable characters stand for themselves, the other bytes for 256 on, in order."""
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
        hidden = [b for b in range(256) if b not in set(shown)]
        byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}
        out = [b""] * (max(self.a.get_vocab(True).values()) + 1)
        for token, i in self.a.get_vocab(True).items():
            out[i] = bytes(map(byte.__getitem__, token)) if all(c in byte for c in token) else token.encode()
        return out

    def _pieces(self) -> list[bytes]:
        out = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            out.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else b"" if self.b.is_unknown(i) or self.b.is_control(i)
                       else piece.replace("▁", " ").encode())
        return out

    @staticmethod
    def _digits(n: int) -> tuple[np.ndarray, np.ndarray]:
        """Decimal digits of 0 to n - 1, right-aligned, and how many there are."""
        width = len(str(n - 1))
        text = np.frombuffer("".join(str(i).rjust(width) for i in range(n)).encode(), np.uint8).reshape(n, width)
        return text, (text != 32).sum(1)

    def stretches(self, text: str) -> list[str]:
        """The text without the single blanks at which it may be cut; each part is encoded with a blank in front."""
        out, at = [], 0
        while self.whole and len(text) - at > STRETCH:
            cut = _BLANK.search(text, at + STRETCH)
            if not cut:
                break
            out.append(text[at:cut.start()])
            at = cut.end()
        return [*out, text[at:]]

    def encode(self, texts: list[str | None]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of A and B of every text; both empty where the text has no tokens."""
        parts = [(k, p) for k, t in enumerate(texts) if t for p in self.stretches(t)]
        a_raw, b_raw, sure = [[] for _ in texts], [[] for _ in texts], [True] * len(texts)
        for start in range(0, len(parts), PARTS):
            some = parts[start:start + PARTS]
            split = [_BLANK.split(p) if self.whole else [p] for _, p in some]
            known = self.words.of({w for ws in split for w in ws}, self._encode_words)
            for (k, _), ws in zip(some, split):
                got = [known[w] for w in ws]
                a_raw[k].append(b"".join([g[0] for g in got]))
                b_raw[k].append(b"".join([g[1] for g in got]))
                sure[k] &= all([g[2] for g in got])
        a_ids, b_ids = ([np.frombuffer(b"".join(r), "<u4").astype(np.int64) for r in raw] for raw in (a_raw, b_raw))
        for k, t in enumerate(texts):
            if not sure[k] and any(b"".join(map(x.__getitem__, ids.tolist())) != (" " + t).encode("utf-8", "surrogatepass")
                                   for x, ids in ((self.a_bytes, a_ids[k]), (self.b_bytes, b_ids[k]))):
                a_ids[k] = b_ids[k] = np.zeros(0, np.int64)
        return a_ids, b_ids

    def _encode_words(self, words: list[str]) -> list[tuple[bytes, bytes, bool]]:
        """Packed ids of A and B of each word with a blank in front, and whether both give back just these bytes."""
        out = []
        for w, e, b in zip(words, self.a.encode_batch_fast([" " + w for w in words], add_special_tokens=False), self.b.encode(words, num_threads=1) if words else ()):
            a, want = e.ids, (" " + w).encode("utf-8", "surrogatepass")
            same = b"".join([self.a_bytes[i] for i in a]) == want == b"".join([self.b_bytes[i] for i in b])
            out.append((array.array("I", a).tobytes(), array.array("I", b).tobytes(), same))
        return out

    def align(self, texts: list[str | None]) -> dict:
        """Per text n_a, n_b, n_groups and the groups as text; per link its text (``doc``) and ``pair``."""
        a_list, b_list = self.encode(texts)
        docs = np.arange(len(texts))
        n_a, n_b = (np.array([len(x) for x in y], np.int64) for y in (a_list, b_list))
        a, b = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (a_list, b_list))
        a_doc, b_doc = np.repeat(docs, n_a), np.repeat(docs, n_b)
        a_end, b_end = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        b_of, a_of = np.searchsorted(b_end, a_end), np.searchsorted(a_end, b_end)  # the token that holds the last byte
        a_last, b_last = (b_end[b_of] == a_end, a_end[a_of] == b_end) if len(a) else (np.zeros(0, bool),) * 2
        rest = ~b_last
        doc = np.concatenate([a_doc, b_doc[rest]])
        left, right = np.concatenate([a, a[a_of[rest]]]), np.concatenate([b[b_of], b[rest]])
        return {"n_a": n_a, "n_b": n_b, "n_groups": np.bincount(a_doc[a_last], minlength=len(texts)), "doc": doc,
                "pair": ((left % RADIX) * self.rows + left // RADIX) * len(self.b_bytes) + right,
                "groups": self._listed(a, b, a_last, b_last, n_a, n_b)}

    def _listed(self, a, b, a_last, b_last, n_a, n_b) -> list[bytes]:
        """``a1,a2|b1;a3|b2,b3`` for every text: decimal ids, groups one after the other."""
        a_group, b_group = np.cumsum(a_last) - a_last, np.cumsum(b_last) - b_last
        groups = int(a_last.sum())
        a_upto, b_upto = np.cumsum(np.bincount(a_group, minlength=groups)), np.cumsum(np.bincount(b_group, minlength=groups))
        a_at = np.arange(len(a)) + np.concatenate([[0], b_upto])[a_group] if len(a) else np.zeros(0, np.int64)
        b_at = np.arange(len(b)) + a_upto[b_group] if len(b) else np.zeros(0, np.int64)
        width = max(self.a_digits[0].shape[1], self.b_digits[0].shape[1])
        cells = np.full((len(a) + len(b), width + 1), 32, np.uint8)
        size = np.zeros(len(cells), np.int64)
        for at, ids, last, (digits, count), end in ((a_at, a, a_last, self.a_digits, "|"), (b_at, b, b_last, self.b_digits, ";")):
            cells[at, width - digits.shape[1]:width] = digits[ids]
            cells[at, width] = np.where(last, ord(end), ord(","))
            size[at] = count[ids] + 1
        flat = cells[cells != 32].tobytes()
        ends = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(n_a + n_b)])].tolist()
        return [flat[x:max(x, y - 1)] for x, y in zip(ends[:-1], ends[1:])]


@functools.lru_cache(maxsize=1)
def aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each distinct value of a sorted array starts, the values, and how often they come."""
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    first = np.flatnonzero(new)
    return first, keys[first], np.diff(np.append(first, len(keys)))


ENCODED = ("run long, radix int, part int, pairs binary, counts binary, docs binary, times binary, place int, key long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string")
_KINDS = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}


def _batch(schema: str, rows: dict[str, list], n: int) -> pa.RecordBatch:
    """A batch of n rows; columns that are not given are null."""
    fields = [f.split() for f in schema.split(", ")]
    made = {c: v if isinstance(v, pa.Array) else pa.array(v) if isinstance(v, np.ndarray) else pa.array(v, _KINDS[dict(fields)[c]]) for c, v in rows.items()}
    return pa.RecordBatch.from_arrays([made[c].cast(_KINDS[k]) if c in made else pa.nulls(n, _KINDS[k]) for c, k in fields], names=[c for c, _ in fields])


class Run:
    """What a task has gathered: per link records of numbered documents."""

    def __init__(self):
        self.pairs, self.docs, self.times, self.records, self.documents = [], [], [], 0, 0

    def add(self, doc: np.ndarray, pair: np.ndarray, texts: int, pairs: int) -> None:
        """Links of ``texts`` documents; ``pair`` is below ``pairs``."""
        _, both, times = counted(np.sort(doc * np.int64(pairs) + pair))
        self.pairs.append((both % pairs).astype(np.uint64))
        self.docs.append((both // pairs + self.documents).astype(np.uint32))
        self.times.append(times.astype(np.uint32))
        self.records += len(both)
        self.documents += texts

    def write(self, run: int, per_radix: int) -> pa.RecordBatch:
        """A row per partition: the list of pairs, in how many documents each is, and its records."""
        pairs, docs, times = (np.concatenate(x) for x in (self.pairs, self.docs, self.times))
        order = np.argsort(pairs, kind="stable")  # documents ascend already
        pairs, docs, times = pairs[order], docs[order], times[order]
        first, distinct, counts = counted(pairs)
        out = {"run": [], "radix": [], "part": [], "pairs": [], "counts": [], "docs": [], "times": []}
        cuts = np.searchsorted(distinct, (np.arange(RADIX + 1) * per_radix).astype(np.uint64))
        edges = np.append(first, len(pairs))
        for r, (x, y) in enumerate(zip(cuts[:-1], cuts[1:])):
            if x < y:
                s, e = edges[x], edges[y]
                for name, value in (("run", run), ("radix", r), ("part", 0), ("pairs", squeeze(steps(distinct[x:y]))),
                                    ("counts", squeeze(counts[x:y].astype(np.uint64))), ("docs", squeeze(steps(docs[s:e]))), ("times", squeeze(times[s:e]))):
                    out[name].append(value)
        return _batch(ENCODED, out, len(out["run"]))


def encode(docs: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Step 1: rows of documents (``place`` given) and of runs (``radix`` given), stored."""

    def run(batches):
        from pyspark import TaskContext

        both, task, made, gathered = aligner(a_path, b_path), TaskContext.get().partitionId(), 0, Run()
        per_radix = both.rows * len(both.b_bytes)
        for whole in batches:
            for part in slices(whole, "text", SLICE_BYTES):
                got = both.align(part.column("text").to_pylist())
                run_id, n = task << 32 | made, part.num_rows
                yield _batch(ENCODED, {
                    "run": [run_id] * n, "place": np.arange(n) + gathered.documents, "key": part.column("key"), "n_a": got["n_a"], "n_b": got["n_b"],
                    "n_groups": got["n_groups"], "n_links": got["n_a"] + got["n_b"] - got["n_groups"],
                    "groups_sha256": [hashlib.sha256(g).hexdigest() if g else "" for g in got["groups"]]}, n)
                gathered.add(got["doc"], got["pair"], n, RADIX * per_radix)
                if gathered.records >= RUN_RECORDS:
                    yield gathered.write(run_id, per_radix)
                    made, gathered = made + 1, Run()
        if gathered.records:
            yield gathered.write(task << 32 | made, per_radix)

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    return materialize(small_batches(rows).mapInArrow(run, ENCODED), "runs")


def entries(parts: list[tuple[bytes, bytes]]) -> Iterator[tuple[int, int]]:
    """Pairs and counts of one list, block by block."""
    for pairs, counts in parts:
        yield from zip(from_steps(pairs, "<u8").tolist(), expand(counts, "<u8").tolist())


def summed(lists: list[list[tuple[bytes, bytes]]]) -> Iterator[tuple[int, int]]:
    """Step 2 for one parent: distinct pairs ascending with the sum of their counts, by a heap over the lists' heads."""
    last, total = None, 0
    for pair, n in heapq.merge(*map(entries, lists)):
        if pair != last:
            if last is not None:
                yield last, total
            last, total = pair, 0
        total += n
    if last is not None:
        yield last, total


def with_best(found: Iterator[tuple[int, int]], b_ids: int) -> Iterator[tuple[int, int, int]]:
    """Pair, count, and 1 if it is the highest count of its A id; pairs of an A id are neighbours."""
    held, owner = [], None
    for pair, n in found:
        if pair // b_ids != owner:
            if held:
                most = max(x[1] for x in held)
                yield from ((p, c, int(c == most)) for p, c in held)
            held, owner = [], pair // b_ids
        held.append((pair, n))
    if held:
        most = max(x[1] for x in held)
        yield from ((p, c, int(c == most)) for p, c in held)


def _blocks(rows: Iterator[tuple]) -> Iterator[tuple[np.ndarray, ...]]:
    """Columns of up to BLOCK rows at a time."""
    while block := list(itertools.islice(rows, BLOCK)):
        yield tuple(np.array(c, np.uint64) for c in zip(*block))


def _groups(batches, *names: str) -> Iterator[tuple[tuple, Iterator[dict]]]:
    """Rows of sorted batches by equal values of the named columns; a group's rows are read as they come."""
    rows = (r for b in batches for r in b.to_pylist())
    return itertools.groupby(rows, key=lambda r: tuple(r[c] for c in names))


def _parent(lists: DataFrame, parents: int) -> DataFrame:
    return lists.withColumn("parent", F.pmod(F.xxhash64("run"), F.lit(parents)).cast("long"))


ANSWERS = "run long, radix int, part int, pairs binary, counts binary, best binary"


def merge(lists: DataFrame, parents: int, b_ids: int | None = None) -> DataFrame:
    """Step 2: one list per partition and parent; with ``b_ids`` the last one, with marks of the best."""

    def run(batches):
        for (radix, parent), rows in _groups(batches, "radix", "parent"):
            of: dict[int, list[tuple[bytes, bytes]]] = {}
            for r in rows:
                of.setdefault(r["run"], []).append((r["pairs"], r["counts"]))
            found = summed(list(of.values()))
            if b_ids is None:
                found = ((p, n, 0) for p, n in found)
            else:
                found = with_best(found, b_ids)
            for k, (pairs, counts, best) in enumerate(_blocks(found)):
                yield _batch(ANSWERS, {"run": [parent], "radix": [radix], "part": [k], "pairs": [squeeze(steps(pairs))],
                                      "counts": [squeeze(counts)], "best": [squeeze(best.astype(np.uint8))]}, 1)

    grouped = _parent(lists.select("run", "radix", "part", "pairs", "counts"), parents)
    return small_batches(grouped).repartition("radix", "parent").sortWithinPartitions("radix", "parent", "run", "part").mapInArrow(run, ANSWERS)


def descend(lists: DataFrame, answers: DataFrame, parents: int) -> DataFrame:
    """Step 3: from the answers for the parents those for each list: counts over all runs and marks of the best, in the order of its pairs."""

    def run(batches):
        for (radix, _), rows in _groups(batches, "radix", "parent"):
            known, pairs = [], None
            for r in rows:
                own = from_steps(r["pairs"], "<u8")
                if not r["below"]:
                    known.append((own, expand(r["counts"], "<u8"), expand(r["best"], "u1")))
                    continue
                if pairs is None:
                    pairs, counts, best = (np.concatenate(x) for x in zip(*known))
                at = np.searchsorted(pairs, own)
                yield _batch(ANSWERS, {"run": [r["run"]], "radix": [radix], "part": [r["part"]], "pairs": [r["pairs"]],
                                       "counts": [squeeze(counts[at])], "best": [squeeze(best[at])]}, 1)

    nothing = F.lit(None).cast("binary")
    asked = _parent(lists, parents).select("radix", "parent", F.lit(True).alias("below"), "run", "part", "pairs", nothing.alias("counts"), nothing.alias("best"))
    told = answers.select("radix", F.col("run").alias("parent"), F.lit(False).alias("below"), "run", "part", "pairs", "counts", "best")
    both = small_batches(told.unionByName(asked)).repartition("radix", "parent").sortWithinPartitions("radix", "parent", "below", "run", "part")
    return both.mapInArrow(run, ANSWERS)


def count_links(runs: DataFrame, b_ids: int, fan: int = FAN) -> DataFrame:
    """Steps 2 and 3: the answers for the lists of all runs.

    The driver gets the number of runs, which tells how many levels there are.
    """
    lists = runs.filter(F.col("radix").isNotNull()).select("run", "radix", "part", "pairs", "counts")
    n, levels = lists.select("run").distinct().count(), []
    while n > fan:
        n = -(-n // (fan // 2))  # a hash deals runs out: half a fan to each parent, more or less
        levels.append((lists, n))
        lists = materialize(merge(lists, n).select("run", "radix", "part", "pairs", "counts"), "lists")
    answers = merge(lists, 1, b_ids)
    for lists, parents in [(lists, 1), *reversed(levels)]:
        answers = descend(lists, answers, parents)
    return answers


def contribute(runs: DataFrame, answers: DataFrame, key: str = "doc_id") -> DataFrame:
    """Step 4: the documents' columns with n_best and count_sum; a run's answers come first, then its records, then its documents."""
    numbers = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    schema = T.StructType([*(T.StructField(c, T.LongType()) for c in (key, *numbers)), T.StructField("groups_sha256", T.StringType())])

    def run(batches):
        of, answer, sums = None, {}, np.zeros((0, 2), np.int64)
        for (run_id, kind), part in neighbours(batches, "run", "kind"):
            if run_id != of:
                of, answer, sums = run_id, {}, np.zeros((0, 2), np.int64)
            if kind == 0:
                for r in part.select(["radix", "counts", "best"]).to_pylist():
                    answer[r["radix"]] = np.stack([expand(r["best"], "u1").astype(np.int64), expand(r["counts"], "<u8").astype(np.int64)], axis=1)
            elif kind == 1:
                for r in part.select(["radix", "counts", "docs", "times"]).to_pylist():
                    place = from_steps(r["docs"], "<u4")
                    sums = _room(sums, int(place.max()) + 1)
                    share = np.repeat(answer.pop(r["radix"]), expand(r["counts"], "<u8").astype(np.int64), axis=0) * expand(r["times"], "<u4").astype(np.int64)[:, None]
                    for k in (0, 1):
                        np.add.at(sums[:, k], place, share[:, k])
            else:
                place = part.column("place").to_numpy()
                sums = _room(sums, int(place.max()) + 1)
                own = sums[place]
                columns = [part.column(c) for c in ("key", *numbers[:4])] + [pa.array(own[:, 0]), pa.array(own[:, 1]), part.column("groups_sha256")]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    stored = runs.select("*", F.when(F.col("radix").isNull(), 2).otherwise(1).alias("kind")).drop("part", "n", "pairs")
    told = answers.select("run", "radix", "counts", "best", F.lit(0).alias("kind"))
    both = small_batches(stored.unionByName(told, allowMissingColumns=True))
    return both.repartition("run").sortWithinPartitions("run", "kind", "radix", "place").mapInArrow(run, schema)


def _room(sums: np.ndarray, n: int) -> np.ndarray:
    """``sums`` with rows for at least n documents."""
    return sums if n <= len(sums) else np.concatenate([sums, np.zeros((max(n, 2 * len(sums)) - len(sums), 2), np.int64)])


def align(docs: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row."""
    runs = encode(docs, a_path, b_path, key, text)
    return contribute(runs, count_links(runs, len(aligner(a_path, b_path).b_bytes)), key)


def link_counts(docs: DataFrame, a_path: str, b_path: str, text: str = "text") -> DataFrame:
    """a, b, documents and best (whether no other pair of the A id has a higher count) of every pair of ids."""
    both = aligner(a_path, b_path)
    rows, b_ids = both.rows, len(both.b_bytes)
    runs = encode(docs.select(F.lit(None).cast("long").alias("key"), F.col(text).alias("text")), a_path, b_path, "key", "text")
    lists = runs.filter(F.col("radix").isNotNull()).select("run", "radix", "part", "pairs", "counts")

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                pair = from_steps(r["pairs"], "<u8").astype(np.int64)
                first = pair // b_ids
                yield pa.RecordBatch.from_arrays([pa.array(first % rows * RADIX + first // rows), pa.array(pair % b_ids), pa.array(expand(r["counts"], "<u8").astype(np.int64)),
                                                  pa.array(expand(r["best"], "u1") == 1)], names=["a", "b", "documents", "best"])

    n = lists.select("run").distinct().count()
    while n > FAN:
        n = -(-n // (FAN // 2))
        lists = materialize(merge(lists, n), "lists")
    return merge(lists, 1, b_ids).mapInArrow(run, "a long, b long, documents long, best boolean")
