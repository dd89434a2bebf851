"""Hard negatives of embedding vectors by vertical scans of their dimensions.

Every component becomes an integer; a row's score is its inner product with an
anchor.  An anchor's positives are its best other rows of the same label; for
each of them, the best rows of other labels whose score lies in a window below
the positive's are its hard negatives.

Anchors meet all rows in blocks: rows are dealt to blocks by a hash, anchors to
groups, and each group meets each block once.  Inside a block the rows lie by
dimension, sorted by label.  For one anchor the dimensions are read from its
largest component down, a few at a time.  The least and greatest value that
each dimension has in the block bound what the dimensions not yet read can add,
so a row's score is known to lie between two bounds that close in; rows that
cannot be among the best, or cannot fall into a window, leave the anchor's
bitmap.  What is left when all dimensions are read has its exact score.

Two passes are needed, since the windows follow from the positives: the first
scans the rows of the anchor's label, the second those of all other labels.  A
block hands on only its best few rows per anchor and window, and a second,
grouped step takes the best of all blocks.  Nothing is dropped: bounds only
skip what provably cannot be in the result.

Rows with a null id, label or vector, and rows with a null or non-finite
component, take no part.  Vectors of different lengths do not meet.  Rows are
told apart by their number in the stored table, so repeated ids are rows of
their own (a copy of an anchor can be its positive, and gives results too);
equal scores go by id, then by row number.  Scores beyond 64 bits raise an
error.  Extra columns are ignored, empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import materialize
from .common import neighbours

POSITIVES, NEGATIVES = 5, 3
LEAST, MOST = 50, 95  # a negative's score in hundredths of the positive's
SCALE = 256
BLOCK_ROWS = 65_536  # rows of a block, at most about so many
SMALL_BLOCK = 2048  # blocks are made smaller than that for no number of tasks
GROUP_ANCHORS = 8192
MOST_TASKS = 4000
STEP = 8  # dimensions read before the bitmap is looked at again


def integers(embedding: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of every component, null where one is null or not finite."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(embedding.isNotNull() & ~bad, F.transform(embedding, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("long")))


def prepare(vectors: DataFrame, anchor: Column, key: Column, embedding: Column, label: Column) -> DataFrame:
    """uid, key, label, dim, anchor and integer vector of the rows that take part, stored."""
    rows = vectors.select(key.cast("long").alias("key"), label.cast("long").alias("label"), integers(embedding).alias("v"), anchor.alias("anchor"))
    rows = rows.filter(F.col("key").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull())
    return materialize(rows.select(F.monotonically_increasing_id().alias("uid"), "key", "label", F.size("v").alias("dim"),
                                   F.coalesce("anchor", F.lit(False)).alias("anchor"), "v"), "vectors")


class Block:
    """Rows of a block by dimension, sorted by label, key and row number."""

    def __init__(self, uid: np.ndarray, key: np.ndarray, label: np.ndarray, vectors: np.ndarray):
        order = np.lexsort((uid, key, label))
        self.uid, self.key, self.label = uid[order], key[order], label[order]
        self.columns = np.ascontiguousarray(vectors[order].T)
        self.low, self.high = (self.columns.min(1), self.columns.max(1)) if len(uid) else (np.zeros(len(self.columns)),) * 2

    def own(self, label: int) -> tuple[int, int]:
        return int(np.searchsorted(self.label, label, "left")), int(np.searchsorted(self.label, label, "right"))


def exact_type(vectors: np.ndarray, anchors: np.ndarray):
    """The fastest number type in which all inner products are exact."""
    if not vectors.size or not anchors.size:
        return np.float64
    most = max(abs(int(vectors.min())), int(vectors.max())) * max(abs(int(anchors.min())), int(anchors.max())) * vectors.shape[1]
    if most >= 1 << 63:
        raise ValueError("scores do not fit 64 bits")
    return np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64


class Scan:
    """One anchor's way through the dimensions of a block."""

    def __init__(self, block: Block, anchor: np.ndarray):
        self.block, self.anchor = block, anchor
        self.order = np.argsort(-np.abs(anchor), kind="stable")
        weight = anchor[self.order]
        low, high = block.low[self.order] * weight, block.high[self.order] * weight
        rest = lambda x: np.concatenate([np.cumsum(x[::-1])[::-1], np.zeros(1, x.dtype)])
        self.least, self.most = rest(np.minimum(low, high)), rest(np.maximum(low, high))  # what dimensions from a place on can add

    def run(self, pieces: list[tuple[int, int]], needed) -> tuple[np.ndarray, np.ndarray]:
        """Places and exact scores of the rows of ``pieces`` (stretches of the block) that stay in the bitmap.

        ``needed(least, most)`` tells from bounds of the scores which rows are still wanted.
        """
        at = np.concatenate([np.arange(a, b) for a, b in pieces]) if pieces else np.zeros(0, np.int64)
        columns, weight = self.block.columns, self.anchor[self.order]
        whole = sum(b - a for a, b in pieces) == len(self.block.uid)
        score = np.zeros(len(at), columns.dtype)
        for d in range(0, len(self.order), STEP):
            dims = self.order[d:d + STEP]
            if whole:
                score += weight[d:d + STEP] @ columns[dims]
            else:
                score += weight[d:d + STEP] @ columns[dims[:, None], at]
            end = d + len(dims)
            if end < len(self.order):
                keep = needed(score + self.least[end], score + self.most[end])
                if not keep.all():
                    at, score, whole = at[keep], score[keep], False
            if not len(at):
                break
        return at, score

    def best(self, at: np.ndarray, score: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The n best rows; higher scores first, ties by key and row number."""
        if len(at) > n:
            edge = np.partition(score, len(score) - n)[len(score) - n]
            keep = score >= edge
            at, score = at[keep], score[keep]
        order = np.lexsort((self.block.uid[at], self.block.key[at], -score.astype(np.int64)))[:n]
        return at[order], score[order]


def kth(values: np.ndarray, k: int):
    """The k-th greatest value, or None where there are fewer."""
    return np.partition(values, len(values) - k)[len(values) - k] if len(values) >= k else None


def positives(block: Block, anchor: np.ndarray, uid: int, label: int, n: int = POSITIVES) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of the block's n best other rows of the label."""
    scan = Scan(block, anchor)

    def needed(least, most):
        edge = kth(least, n + 1)  # the anchor itself may be one of them
        return np.ones(len(least), bool) if edge is None else most >= edge

    a, b = block.own(label)
    at, score = scan.run([(a, b)] if a < b else [], needed)
    other = block.uid[at] != uid
    return scan.best(at[other], score[other], n)


def windows(scores: np.ndarray, least: int = LEAST, most: int = MOST) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest whole score between ``least`` and ``most`` hundredths of each score."""
    s = [int(x) for x in scores]
    return np.array([-(-least * x // 100) for x in s], np.int64), np.array([most * x // 100 for x in s], np.int64)


def negatives(block: Block, anchor: np.ndarray, label: int, low: np.ndarray, high: np.ndarray, n: int = NEGATIVES) -> list[tuple[np.ndarray, np.ndarray]]:
    """For every window the places and scores of the block's n best rows of other labels inside it."""
    scan = Scan(block, anchor)
    spans = sorted({(int(a), int(b)) for a, b in zip(low, high) if a <= b})

    def needed(least, most):
        keep = np.zeros(len(least), bool)
        for a, b in spans:
            surely = (least >= a) & (most <= b)
            edge = kth(least[surely], n)
            keep |= (least <= b) & (most >= (a if edge is None else max(a, edge)))
        return keep

    a, b = block.own(label)
    at, score = scan.run([p for p in ((0, a), (b, len(block.uid))) if p[0] < p[1]] if spans else [], needed)
    out = []
    for lo, hi in zip(low, high):
        inside = (score >= lo) & (score <= hi)
        out.append(scan.best(at[inside], score[inside], n))
    return out


def blocks_and_groups(rows: DataFrame) -> tuple[int, int]:
    """How many blocks of rows and groups of anchors there are; two counts reach the driver."""
    r = rows.agg(F.count("*").alias("n"), F.count_if("anchor").alias("m")).first()
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups = max(1, -(-r["m"] // GROUP_ANCHORS))
    return max(1, -(-r["n"] // BLOCK_ROWS), min(-(-tasks // groups), r["n"] // SMALL_BLOCK)), groups


def meetings(rows: DataFrame, anchors: DataFrame, blocks: int, groups: int) -> DataFrame:
    """Every row once per group of anchors, every anchor once per block of rows, sorted by meeting; anchors come after rows."""
    side = lambda df, own, other, n, second, more: df.select(
        F.pmod(F.xxhash64("uid"), F.lit(other[1])).cast("int").alias(other[0]), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(own),
        "dim", F.lit(second).alias("second"), "uid", "key", "label", "v", *more)
    nothing = [F.lit(None).cast("array<long>").alias(c) for c in ("positive_uid", "positive_key", "positive_score")]
    cells = side(rows, "g", ("b", blocks), groups, False, nothing)
    asks = side(anchors, "b", ("g", groups), blocks, True, ["positive_uid", "positive_key", "positive_score"])
    keys, tasks = ["dim", "g", "b"], int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(tasks, min(4 * blocks * groups, MOST_TASKS))  # several for each meeting, so that few tasks get two
    return cells.unionByName(asks).repartition(parts, *keys).sortWithinPartitions(*keys, "second", "uid")


def answers(met: DataFrame, answer, schema: str) -> DataFrame:
    """``answer(block, uid, key, label, vector, batch, row)`` gives result rows for each anchor of each meeting."""
    names = [f.split()[0] for f in schema.split(", ")]

    def vectors(b: pa.RecordBatch) -> np.ndarray:
        v = b.column("v")
        return v.flatten().to_numpy().reshape(b.num_rows, -1) if b.num_rows and b.column("dim")[0].as_py() else np.zeros((b.num_rows, 0), np.int64)

    def run(batches):
        of, held, block = None, [], None
        for (*meeting, second), part in neighbours(batches, "dim", "g", "b", "second"):
            if meeting != of:
                of, held, block = meeting, [], None
            if not second:
                held.append((*(part.column(c).to_numpy() for c in ("uid", "key", "label")), vectors(part)))
                continue
            if not held:
                continue
            asked = vectors(part)
            if block is None:
                uid, key, label, v = (np.concatenate(x) for x in zip(*held))
                held = [(uid, key, label, v)]
                block = {}
            kind = exact_type(held[0][3], asked)
            if kind not in block:
                block[kind] = Block(*held[0][:3], held[0][3].astype(kind))
            rows = []
            uid, label, key = (part.column(c).to_numpy() for c in ("uid", "label", "key"))
            for i in range(part.num_rows):
                rows += answer(block[kind], asked[i].astype(kind), int(uid[i]), int(key[i]), int(label[i]), part, i)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=names)

    return met.mapInArrow(run, schema)


def first_of(found: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group with their ``rank``; groups hold a few rows per block."""
    return found.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= n)


def mine(rows: DataFrame, n_positives: int = POSITIVES, n_negatives: int = NEGATIVES, least: int = LEAST, most: int = MOST) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score from rows as ``prepare`` gives them."""
    blocks, groups = blocks_and_groups(rows)
    none = [F.lit(None).cast("array<long>").alias(c) for c in ("positive_uid", "positive_key", "positive_score")]
    anchors = rows.filter("anchor")

    def best_positives(block, vector, uid, key, label, part, i):
        at, score = positives(block, vector, uid, label, n_positives)
        return [(uid, int(u), int(k), int(s)) for u, k, s in zip(block.uid[at], block.key[at], score)]

    found = answers(meetings(rows, anchors.select("*", *none), blocks, groups), best_positives, "anchor_uid long, uid long, key long, score long")
    top = first_of(found, ["anchor_uid"], [F.desc("score"), F.col("key"), F.col("uid")], n_positives)
    listed = top.groupBy(F.col("anchor_uid").alias("uid")).agg(F.sort_array(F.collect_list(F.struct("rank", "uid", "key", "score"))).alias("p")).select(
        "uid", F.col("p.uid").alias("positive_uid"), F.col("p.key").alias("positive_key"), F.col("p.score").alias("positive_score"))
    asking = materialize(anchors.join(listed, "uid"), "anchors")

    def best_negatives(block, vector, uid, key, label, part, i):
        score = part.column("positive_score")[i].values.to_numpy()
        low, high = windows(score, least, most)
        out = []
        for k, (at, s) in enumerate(negatives(block, vector, label, low, high, n_negatives)):
            p_uid, p_key = part.column("positive_uid")[i].values[k].as_py(), part.column("positive_key")[i].values[k].as_py()
            out += [(uid, key, p_uid, p_key, int(score[k]), int(u), int(n), int(x)) for u, n, x in zip(block.uid[at], block.key[at], s)]
        return out

    hard = answers(meetings(rows, asking, blocks, groups), best_negatives,
                   "uid long, anchor_id long, positive_uid long, positive_id long, positive_score long, negative_uid long, negative_id long, negative_score long")
    return first_of(hard, ["uid", "positive_uid"], [F.desc("negative_score"), F.col("negative_id"), F.col("negative_uid")], n_negatives).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def hard_negatives(vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding", label: str = "label", every: int = 50) -> DataFrame:
    """Hard negatives of the rows whose id is divisible by ``every``."""
    k = F.col(key)
    return mine(prepare(vectors, k % every == 0, k, F.col(embedding), F.col(label)))
