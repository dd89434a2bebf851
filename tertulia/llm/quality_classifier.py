"""Document quality by attention over passages.

A document is a bag of passages of 64 words.  Each passage is encoded as a
vector (shares of kinds of characters and words, hashed pairs of letters, then
a learned layer); a learned gated attention weighs the passages of a document,
and the weighted passage vector is scored.  Only documents are labelled, so the
weights of passages are learned from the documents' labels.

Training takes a bounded sample of labelled documents (``sample`` rows, and at
most ``train_passages`` evenly spaced passages of each) and runs on the driver;
scoring is narrow and reads every passage of every text.  A null or empty text
is one passage without words.  Without any labels every score is 0.5; with one
kind of label it is that label's smoothed share.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .common import binary, bytes_of, mix, slices, small_batches

PASSAGE = 64
SAMPLE = 3000
TRAIN_PASSAGES = 48
HASHED = 48
HIDDEN, ATTENTION = 24, 16
STEPS = 250
THRESHOLD = 0.3
KINDS = 7  # blank, lower case, upper case, digit, symbol, other mark, not ASCII
SINGLE = b"!|*.,?"
SLICE_BYTES = 1 << 20  # encoding needs about a hundred bytes of memory per byte of text

_KIND = np.full(256, 6, np.uint8)
_KIND[:128] = 5
_KIND[[32, *range(9, 14)]] = 0
_KIND[ord("a"):ord("z") + 1] = 1
_KIND[ord("A"):ord("Z") + 1] = 2
_KIND[ord("0"):ord("9") + 1] = 3
_KIND[list(b"#*$%&|<>")] = 4
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32


def encode_passages(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of all passages of a batch, and where each document's passages start (one more entry than documents)."""
    n = len(offsets) - 1
    kind = _KIND[data]
    dark = kind > 0
    start = dark.copy()
    start[1:] &= ~dark[:-1]
    begins = offsets[:-1][offsets[:-1] < offsets[1:]]
    start[begins] = dark[begins]
    word_at = np.flatnonzero(start)
    word_doc = np.searchsorted(offsets, word_at, "right") - 1
    words = np.bincount(word_doc, minlength=n)
    passages = np.maximum(1, -(-words // PASSAGE))
    bounds = np.concatenate([[0], np.cumsum(passages)])
    first_word = np.cumsum(words) - words
    word_passage = bounds[word_doc] + (np.arange(len(word_at)) - first_word[word_doc]) // PASSAGE
    total = int(bounds[-1])
    own = np.flatnonzero(dark)
    of_word = np.cumsum(start)[own] - 1
    of_passage = word_passage[of_word]
    byte, kinds = data[own], kind[own]
    size = np.bincount(of_passage, minlength=total).astype(np.float64)
    count = np.bincount(word_passage, minlength=total).astype(np.float64)
    per_byte, per_word = np.maximum(size, 1), np.maximum(count, 1)
    share = np.bincount(of_passage * KINDS + kinds, minlength=total * KINDS).reshape(total, KINDS) / per_byte[:, None]
    single = np.stack([np.bincount(of_passage[byte == b], minlength=total) / per_word for b in SINGLE], axis=1)
    # words: hashes to see repeats, and whether they hold upper-case letters only
    weight = mix(byte.astype(np.uint64) + np.uint64(1) + (np.uint64(256) * (own - word_at[of_word]).astype(np.uint64)))
    word_hash = mix(np.add.reduceat(weight, np.searchsorted(own, word_at))) if len(word_at) else np.zeros(0, np.uint64)
    again = np.zeros(len(word_at))
    again[1:] = (word_hash[1:] == word_hash[:-1]) & (word_passage[1:] == word_passage[:-1])
    _, at = np.unique(word_hash ^ mix(word_passage.astype(np.uint64)), return_index=True)
    distinct = np.bincount(word_passage[at], minlength=total) / per_word
    lower, upper = (np.bincount(of_word[kinds == k], minlength=len(word_at)) for k in (1, 2))
    loud = np.bincount(word_passage, weights=(upper > 1) & (lower == 0), minlength=total) / per_word
    repeats = np.bincount(word_passage, weights=again, minlength=total) / per_word
    # hashed pairs of neighbouring letters of a word
    pair = np.flatnonzero(of_word[1:] == of_word[:-1])
    low = _LOWER[byte].astype(np.uint64)
    slot = (mix(low[pair] * np.uint64(256) + low[pair + 1]) % np.uint64(HASHED)).astype(np.int64)
    hashed = np.sqrt(np.bincount(of_passage[pair] * HASHED + slot, minlength=total * HASHED).reshape(total, HASHED) / per_byte[:, None])
    more = np.stack([size / per_word / 10, count / PASSAGE, distinct, loud, repeats], axis=1)
    return np.concatenate([share[:, 1:], single, more, hashed], axis=1).astype(np.float32), bounds


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class AttentionModel:
    """Encoder layer, gated attention and score; trained with Adam on the log loss, both labels weighing alike."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, seed: int = 7):
        r = np.random.default_rng(seed)
        normal = lambda a, b: r.normal(0, 1 / np.sqrt(a), (a, b))
        self.mean, self.scale, self.constant = mean, scale, None
        self.p = {"w": normal(len(mean), HIDDEN), "b": np.zeros(HIDDEN), "v": normal(HIDDEN, ATTENTION), "u": normal(HIDDEN, ATTENTION),
                  "a": normal(ATTENTION, 1)[:, 0], "o": normal(HIDDEN, 1)[:, 0], "c": np.zeros(1)}

    def forward(self, x: np.ndarray, bounds: np.ndarray) -> dict[str, np.ndarray]:
        p, starts = self.p, bounds[:-1]
        doc = np.repeat(np.arange(len(starts)), np.diff(bounds))
        h = np.tanh((x - self.mean) / self.scale @ p["w"] + p["b"])
        t, g = np.tanh(h @ p["v"]), _sigmoid(h @ p["u"])
        e = (t * g) @ p["a"]
        e = np.exp(e - np.maximum.reduceat(e, starts)[doc])
        alpha = e / np.add.reduceat(e, starts)[doc]
        z = np.add.reduceat(alpha[:, None] * h, starts, axis=0)
        return {"doc": doc, "h": h, "t": t, "g": g, "alpha": alpha, "z": z, "score": _sigmoid(z @ p["o"] + p["c"][0])}

    def score(self, x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(bounds) - 1, self.constant)
        return self.forward(x, bounds)["score"]

    def fit(self, x: np.ndarray, bounds: np.ndarray, label: np.ndarray, steps: int = STEPS, rate: float = 0.02, decay: float = 1e-4) -> None:
        p, scaled = self.p, (x - self.mean) / self.scale
        weight = np.where(label == 1, 0.5 / max(label.sum(), 1), 0.5 / max((1 - label).sum(), 1))
        first, second = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
        for step in range(1, steps + 1):
            f = self.forward(x, bounds)
            doc, h, t, g, alpha = f["doc"], f["h"], f["t"], f["g"], f["alpha"]
            d_logit = (f["score"] - label) * weight
            d_z = d_logit[:, None] * p["o"]
            d_alpha = np.einsum("ij,ij->i", d_z[doc], h)
            d_e = alpha * (d_alpha - np.add.reduceat(alpha * d_alpha, bounds[:-1])[doc])
            d_t, d_g = d_e[:, None] * p["a"] * g * (1 - t * t), d_e[:, None] * p["a"] * t * g * (1 - g)
            d_h = (alpha[:, None] * d_z[doc] + d_t @ p["v"].T + d_g @ p["u"].T) * (1 - h * h)
            grad = {"w": scaled.T @ d_h, "b": d_h.sum(0), "v": h.T @ d_t, "u": h.T @ d_g, "a": (t * g).T @ d_e,
                    "o": f["z"].T @ d_logit, "c": np.array([d_logit.sum()])}
            for k in p:
                d = grad[k] + decay * p[k]
                first[k] = 0.9 * first[k] + 0.1 * d
                second[k] = 0.999 * second[k] + 0.001 * d * d
                p[k] -= rate * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-8)


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> AttentionModel:
    """Learns from labelled rows that are not held out; the ``sample`` ids of least hash are taken."""
    marked = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(F.col(key)))
    ids = marked.groupBy(F.col(key).alias("_id")).agg((F.avg(label) >= 0.5).cast("int").alias("_label"))
    ids = ids.orderBy(F.xxhash64("_id"), "_id").limit(sample)
    rows = docs.select(key, text).join(F.broadcast(ids), F.col(key) == F.col("_id")).select("_id", "_label", text)
    schema = "_id long, _label int, n int, x binary"

    def run(batches):
        for whole in batches:
            for part in slices(whole, text, SLICE_BYTES):
                x, bounds = encode_passages(*bytes_of(binary(part.column(text))))
                bags = []
                for a, b in zip(bounds[:-1], bounds[1:]):
                    bags.append(x[a:b] if b - a <= TRAIN_PASSAGES else x[np.linspace(a, b - 1, TRAIN_PASSAGES).astype(np.int64)])
                yield pa.RecordBatch.from_arrays(
                    [part.column("_id").cast(pa.int64()), part.column("_label"), pa.array([len(v) for v in bags], pa.int32()),
                     pa.array([v.tobytes() for v in bags], pa.binary())], names=["_id", "_label", "n", "x"])

    got = sorted(small_batches(rows).mapInArrow(run, schema).collect(), key=lambda r: (r["_id"], bytes(r["x"])))
    ones = sum(r["_label"] for r in got)
    if not got or ones in (0, len(got)):
        model = AttentionModel(np.zeros(1), np.ones(1))
        model.constant = (ones + 1) / (len(got) + 2)
        return model
    x = np.concatenate([np.frombuffer(r["x"], np.float32).reshape(r["n"], -1) for r in got]).astype(np.float64)
    bounds = np.concatenate([[0], np.cumsum([r["n"] for r in got])])
    model = AttentionModel(x.mean(0), x.std(0) + 1e-3)
    model.fit(x, bounds, np.array([r["_label"] for r in got], np.float64))
    return model


def score(docs: DataFrame, model: AttentionModel, text: str = "text", out: str = "score") -> DataFrame:
    """All columns of ``docs`` plus ``out`` (0 to 1); a column of that name is replaced."""
    keep = [c for c in docs.columns if c != out]
    schema = T.StructType([*[docs.schema[c] for c in keep], T.StructField(out, T.DoubleType(), False)])

    def run(batches):
        for whole in batches:
            for part in slices(whole, text, SLICE_BYTES):
                scores = model.score(*encode_passages(*bytes_of(binary(part.column(text)))))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], pa.array(scores.astype(np.float64))], names=[*keep, out])

    return small_batches(docs.select(*keep)).mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, held_out, score and predicted (1 from THRESHOLD on) of every row."""
    model = train(docs, labels, key, text)
    return score(docs.select(key, text), model, text).select(
        key, held_out(F.col(key)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject, unchanged."""
    from .common import free_name

    name = free_name(docs, "score")
    return score(docs, train(docs, labels, key, text), text, name).filter(F.col(name) >= THRESHOLD).drop(name)
