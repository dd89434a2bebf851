"""Toxicity by a factorization machine over hashed terms.

Terms of a text are its distinct words (runs of letters, in lower case), the
beginnings of these words (``PREFIXES`` letters, so that inflected and compound
forms share terms), and one term for the magnitude of the number of words.
They are hashed to ``CELLS`` cells, of which those that tell the labels apart
best are kept.  The model scores a text's kept cells with one weight each and
one product of factors for every pair of them: an insult may weigh more beside
the mention of a group, or less in a very long text, than the sum of the two.

Training takes a bounded sample of labelled documents (``sample`` ids of least
hash, one row each); Spark counts in how many of them each cell occurs, and at
most ``features`` cells and the sample's kept cells reach the driver.  Scoring
is narrow and reads every term of every text, a very long text in stretches.

A null text counts as empty and has only the term of its length; repeated rows
get the same score.  Rows of ``labels`` without key or label are left out, and
keys labelled more than once take the more frequent label (toxic on a tie).
Without any labels every score is 0.5; with one kind of label it is that
label's smoothed share.  Empty tables give empty results, and extra columns are
carried (``score``) or dropped (``classify``) whatever their names.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..session import materialize
from .common import slices, small_batches

CELLS = 1 << 20
PREFIXES = (3, 4, 5, 6, 7, 8)
SAMPLE = 8000
FEATURES = 1024
LEAST_DOCS = 4  # sampled documents that must hold a kept cell
FACTORS = 8
STEPS = 160
THRESHOLD = 0.5
SLICE_BYTES = 1 << 20
STRETCH = 1 << 20  # characters of one text split into words at once
CACHE_ENTRIES = 150_000
_WORD = re.compile(r"[^\W\d_]+")


def word_cells(word: str) -> list[int]:
    """Cells of a word and of its beginnings."""
    terms = ["w:" + word, *("p:" + word[:n] for n in PREFIXES if n <= len(word))]
    return [zlib.crc32(t.encode("utf-8", "surrogatepass")) % CELLS for t in terms]


def length_cell(words: int) -> int:
    return zlib.crc32(b"n:%d" % words.bit_length()) % CELLS


def words_of(text: str):
    """Sets of distinct words of each stretch of a text, and how many words the stretch has; stretches end at a word's end."""
    low, at = text.lower(), 0
    while at < len(low):
        end = min(at + STRETCH, len(low))
        while end < len(low) and low[end - 1].isalpha() and low[end].isalpha():
            end += 1
        found = _WORD.findall(low, at, end)
        yield set(found), len(found)
        at = end


class Terms:
    """Cells of texts; with ``kept``, places in that ascending list of cells instead, other cells left out."""

    def __init__(self, kept: np.ndarray | None = None):
        self.place = None if kept is None else {c: k for k, c in enumerate(kept.tolist())}
        self.marked: dict[str, list[int]] = {}  # words met lately that have cells
        self.blank: set[str] = set()  # words met lately that have none

    def _cells(self, cells: list[int]) -> list[int]:
        return cells if self.place is None else [self.place[c] for c in cells if c in self.place]

    def _learn(self, words: set[str]) -> None:
        for w in words:
            if cells := self._cells(word_cells(w)):
                self.marked[w] = cells
            else:
                self.blank.add(w)

    def of(self, text: str) -> list[int]:
        """Distinct cells (places), ascending."""
        out, count = set(), 0
        for words, n in words_of(text):
            count += n
            if fresh := words - self.blank - self.marked.keys():
                if len(self.marked) + len(self.blank) + len(fresh) > CACHE_ENTRIES:
                    self.marked, self.blank, fresh = {}, set(), words
                self._learn(fresh)
            for w in words & self.marked.keys():
                out.update(self.marked[w])
        out.update(self._cells([length_cell(count)]))
        return sorted(out)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class FactorizationMachine:
    """Weights, factors and their training with Adam on the log loss over rows of present features."""

    def __init__(self, features: int, factors: int = FACTORS, seed: int = 3):
        self.bias, self.weight = np.zeros(1), np.zeros(features)
        self.factor = np.random.default_rng(seed).normal(0, 0.01, (features, factors))

    def logits(self, places: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Of rows that list the features they have; ``bounds`` tells where each starts (one more entry than rows)."""
        return self._forward(places, bounds)[0]

    def _forward(self, places: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        v = self.factor[places]
        add = lambda x: np.diff(np.concatenate([np.zeros((1, *x.shape[1:])), np.cumsum(x, axis=0)])[bounds], axis=0)
        sums = add(v)
        return self.bias[0] + add(self.weight[places]) + 0.5 * ((sums * sums).sum(1) - add((v * v).sum(1))), sums

    def gradient(self, places: np.ndarray, bounds: np.ndarray, label: np.ndarray) -> list[np.ndarray]:
        """Of the mean log loss, for bias, weight and factor."""
        logit, sums = self._forward(places, bounds)
        d = (_sigmoid(logit) - label) / len(label)
        row = np.repeat(np.arange(len(label)), np.diff(bounds))
        n, per = len(self.weight), d[row]
        weight = np.bincount(places, weights=per, minlength=n)
        pull = np.stack([np.bincount(places, weights=per * sums[row, f], minlength=n) for f in range(self.factor.shape[1])], axis=1)
        return [np.array([d.sum()]), weight, pull - weight[:, None] * self.factor]

    def fit(self, places: np.ndarray, bounds: np.ndarray, label: np.ndarray, steps: int = STEPS, rate: float = 0.05,
            decay: tuple[float, float] = (1e-4, 1e-3)) -> None:
        share = (label.sum() + 1) / (len(label) + 2)
        self.bias[0] = np.log(share / (1 - share))
        params = [self.bias, self.weight, self.factor]
        first, second = ([np.zeros_like(p) for p in params] for _ in range(2))
        for step in range(1, steps + 1):
            for p, g, m, s, c in zip(params, self.gradient(places, bounds, label), first, second, (0, *decay)):
                g = g + c * p
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                p -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(s / (1 - 0.999 ** step)) + 1e-8)


class ToxicityModel:
    """Kept cells with the machine over them, or a constant score where there was nothing to learn from."""

    def __init__(self, kept: np.ndarray, machine: FactorizationMachine | None, constant: float = 0.5):
        self.kept, self.machine, self.constant = kept, machine, constant

    def scores(self, terms: Terms, texts: list[str]) -> np.ndarray:
        if self.machine is None:
            return np.full(len(texts), self.constant)
        rows = [terms.of(t) for t in texts]
        bounds = np.cumsum([0, *map(len, rows)])
        return _sigmoid(self.machine.logits(np.array([p for r in rows for p in r], np.int64), bounds))


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string")) % 5 == 0, F.lit(False))


def _texts(column: pa.Array) -> list[str]:
    return [t or "" for t in column.to_pylist()]


def sampled(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, sample: int) -> DataFrame:
    """_id, _label and _text of labelled documents that are not held out: the ``sample`` ids of least hash, stored."""
    marked = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(F.col(key)))
    ids = marked.groupBy(F.col(key).alias("_id")).agg((F.avg(label) >= 0.5).cast("int").alias("_label"))
    ids = F.broadcast(ids.orderBy(F.xxhash64("_id"), "_id").limit(sample))
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(ids, F.col("_key") == F.col("_id"))
    return materialize(rows.groupBy("_id", "_label").agg(F.min("_text").alias("_text")), "sample")


def choose_cells(sample: DataFrame, ones: int, rows: int, features: int = FEATURES) -> np.ndarray:
    """The cells whose presence tells the labels apart best (G statistic), ascending; ``ones`` of the ``rows`` have label 1."""

    def run(batches):
        terms = Terms()
        for whole in batches:
            for part in slices(whole, "_text", SLICE_BYTES):
                for text, label in zip(_texts(part.column("_text")), part.column("_label").to_pylist()):
                    cells = np.array(terms.of(text), np.int32)
                    for a in range(0, len(cells), 1 << 16):
                        yield pa.RecordBatch.from_arrays([pa.array(cells[a:a + (1 << 16)]), pa.array(np.full(len(cells[a:a + (1 << 16)]), label, np.int32))],
                                                         names=["cell", "label"])

    counts = small_batches(sample).mapInArrow(run, "cell int, label int").groupBy("cell").agg(
        F.sum("label").alias("ones"), F.count("*").alias("n")).filter(F.col("n") >= LEAST_DOCS)
    part = lambda seen, expected: F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)
    with_one, n, share = F.col("ones"), F.col("n"), ones / rows
    gone, missing = ones - with_one, rows - n
    strength = (part(with_one, n * share) + part(n - with_one, n * (1 - share)) + part(gone, missing * share)
                + part(missing - gone, missing * (1 - share)))
    best = counts.select("cell", F.round(strength, 6).alias("strength")).orderBy(F.desc("strength"), "cell").limit(features)
    return np.sort(np.array([r["cell"] for r in best.collect()], np.int64))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE,
          features: int = FEATURES) -> ToxicityModel:
    """Learns from labelled rows that are not held out."""
    rows = sampled(docs, labels, key, text, label, sample)
    seen = {r["_label"]: r["count"] for r in rows.groupBy("_label").count().collect()}
    if len(seen) < 2:
        return ToxicityModel(np.zeros(0, np.int64), None, (seen.get(1, 0) + 1) / (sum(seen.values()) + 2))
    kept = choose_cells(rows, seen[1], sum(seen.values()), features)

    def run(batches):
        terms = Terms(kept)
        for whole in batches:
            for part in slices(whole, "_text", SLICE_BYTES):
                found = [np.array(terms.of(t), "<u2").tobytes() for t in _texts(part.column("_text"))]
                yield pa.RecordBatch.from_arrays([part.column("_id").cast(pa.int64()), part.column("_label"), pa.array(found, pa.binary())],
                                                 names=["_id", "_label", "places"])

    got = sorted(small_batches(rows).mapInArrow(run, "_id long, _label int, places binary").collect(), key=lambda r: r["_id"])
    bags = [np.frombuffer(bytes(r["places"]), "<u2").astype(np.int64) for r in got]
    machine = FactorizationMachine(len(kept))
    machine.fit(np.concatenate(bags), np.cumsum([0, *map(len, bags)]), np.array([r["_label"] for r in got], np.float64))
    return ToxicityModel(kept, machine)


def score(docs: DataFrame, model: ToxicityModel, text: str = "text", out: str = "score") -> DataFrame:
    """All columns of ``docs`` plus ``out`` (0 to 1); a column of that name is replaced."""
    keep = [c for c in docs.columns if c != out]
    schema = T.StructType([*[docs.schema[c] for c in keep], T.StructField(out, T.DoubleType(), False)])

    def run(batches):
        terms = Terms(model.kept)
        for whole in batches:
            for part in slices(whole, text, SLICE_BYTES):
                found = model.scores(terms, _texts(part.column(text)))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], pa.array(found.astype(np.float64))], names=[*keep, out])

    return small_batches(docs.select(*keep)).mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, held_out, score and predicted (1 from THRESHOLD on) of every row."""
    model = train(docs, labels, key, text)
    return score(docs.select(key, text), model, text).select(
        key, held_out(F.col(key)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
