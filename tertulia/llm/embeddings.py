"""Near-duplicate vectors by spherical k-means cells and blocked cosine products.

Centres are learned from a bounded sample (``SAMPLE_PER_CELL`` vectors for each
of at most ``MAX_CELLS`` cells, by least hash).  Every vector goes to its
nearest cell and to those nearly as near (cosine within ``MARGIN``), so that
pairs across a border meet; vectors meet only under equal labels and lengths.
Inside a cell, blocks of vectors are multiplied block by block in double
precision.  A pair is counted in the first cell both vectors share.  Blocks
whose bounding cones show that all pairs link, or none can, skip the product.

Equal vectors under a label form one class with a weight before anything is
compared, and a task hands on only counts per vector and enough links to keep
groups together.

Vectors that are null, zero, or hold null or non-finite components, and rows
with a null label, link with nothing.  Each row is a vector, also if its id is
null or repeated; a component is named by its least id.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import materialize
from .links import connected

SIMILARITY = 0.93
ROWS_PER_CELL = 1024
MAX_CELLS = 1024
SAMPLE_PER_CELL = 64
MARGIN = 0.15
ROUNDS = 12
BLOCK = 1024
CHUNK = 4096


def unit(v: list | None) -> np.ndarray | None:
    """The vector at length 1, or None if it has no direction."""
    if not v or any(x is None for x in v):
        return None
    a = np.asarray(v, np.float64)
    if not np.isfinite(a).all() or not a.any():
        return None
    a = a / np.abs(a).max()
    return a / np.sqrt((a * a).sum())


def prepare(vectors: DataFrame, key: str, embedding: str, label: str) -> DataFrame:
    """uid, key, label, dim, digest and unit vector (bytes; null if it links with nothing)."""
    rows = vectors.select(F.monotonically_increasing_id().alias("uid"), F.col(key).cast("long").alias("key"), F.col(label).cast("string").alias("label"),
                          F.col(embedding).alias("v"))

    def run(batches):
        for whole in batches:
            for a in range(0, whole.num_rows, CHUNK):
                part = whole.slice(a, CHUNK)
                units = [None if x is None else unit(v) for x, v in zip(part.column("label").to_pylist(), part.column("v").to_pylist())]
                raw = [None if u is None else u.tobytes() for u in units]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in ("uid", "key", "label")), pa.array([None if u is None else len(u) for u in units], pa.int32()),
                     pa.array([None if r is None else hashlib.blake2b(r, digest_size=16).digest() for r in raw], pa.binary()), pa.array(raw, pa.binary())],
                    names=["uid", "key", "label", "dim", "digest", "vec"])

    return rows.mapInArrow(run, "uid long, key long, label string, dim int, digest binary, vec binary")


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 5) -> np.ndarray:
    """k unit centres; an empty cell takes the vector that fits its own centre worst."""
    centres = x[np.random.default_rng(seed).choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = np.concatenate([x[a:a + CHUNK] @ centres.T for a in range(0, len(x), CHUNK)])
        cell, fit = near.argmax(1), near.max(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, cell, x)
        empty = np.flatnonzero(np.bincount(cell, minlength=k) == 0)
        sums[empty] = x[np.argsort(fit)[:len(empty)]]
        length = np.sqrt((sums * sums).sum(1, keepdims=True))
        centres = np.where(length > 1e-12, sums / np.maximum(length, 1e-12), centres)
    return centres


def learn_cells(classes: DataFrame) -> dict[int, np.ndarray]:
    """Centres per vector length, learned from the vectors of least hash."""
    total = classes.count()
    k = min(MAX_CELLS, -(-total // ROWS_PER_CELL))
    if k <= 1:
        return {}
    sample = classes.select("dim", "vec", "uid").orderBy(F.xxhash64("digest"), "uid").limit(k * SAMPLE_PER_CELL).collect()
    by_dim: dict[int, list[bytes]] = {}
    for r in sample:
        by_dim.setdefault(r["dim"], []).append(bytes(r["vec"]))
    out = {}
    for dim, raw in by_dim.items():
        x = np.frombuffer(b"".join(raw)).reshape(-1, dim)
        own = max(1, k * len(x) // len(sample))
        out[dim] = spherical_kmeans(x, own)
    return out


def assign(classes: DataFrame, centres: dict[int, np.ndarray]) -> DataFrame:
    """Adds ``cells``: the nearest cell and those within the margin, ascending."""

    def run(batches):
        for whole in batches:
            for a in range(0, whole.num_rows, CHUNK):
                part = whole.slice(a, CHUNK)
                cells = []
                for dim, v in zip(part.column("dim").to_pylist(), part.column("vec").to_pylist()):
                    if dim in centres:
                        near = centres[dim] @ np.frombuffer(v)
                        cells.append(np.flatnonzero(near >= near.max() - MARGIN).tolist())
                    else:
                        cells.append([0])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cells, pa.list_(pa.int32()))], names=[*part.schema.names, "cells"])

    return classes.mapInArrow(run, "label string, dim int, digest binary, uid long, weight long, vec binary, cells array<int>")


class Block:
    def __init__(self, rows: list[dict], cell: int):
        self.uid = np.array([r["uid"] for r in rows])
        self.weight = np.array([r["weight"] for r in rows])
        self.x = np.frombuffer(b"".join(r["vec"] for r in rows)).reshape(len(rows), -1)
        self.before = np.zeros((len(rows), cell), np.float32)  # cells before this one
        for k, r in enumerate(rows):
            self.before[k, [c for c in r["cells"] if c < cell]] = 1
        mean = self.x.sum(0)
        length = np.sqrt((mean * mean).sum())
        self.centre = mean / length if length > 1e-9 else self.x[0]
        self.angle = float(np.arccos(np.clip((self.x @ self.centre).min(), -1, 1)))


def linked(a: Block, b: Block, similarity: float) -> np.ndarray:
    """Which pairs of the blocks link and have this cell as the first one both share."""
    apart, reach, limit = np.arccos(np.clip(a.centre @ b.centre, -1, 1)), a.angle + b.angle, np.arccos(similarity)
    if apart - reach > limit + 1e-6:
        return np.zeros((len(a.uid), len(b.uid)), bool)
    out = np.ones((len(a.uid), len(b.uid)), bool) if apart + reach < limit - 1e-6 else a.x @ b.x.T >= similarity
    if a.before.any() and b.before.any() and out.any():
        out &= a.before @ b.before.T == 0
    return out


def spanning(links: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) that keep together what the links of the two blocks join: breadth first over rows and columns."""
    rows_left, columns_left, out = links.any(1), links.any(0), []
    while rows_left.any():
        start = int(rows_left.argmax())
        rows_left[start] = False
        front = [start]
        while front:
            following = []
            for i in front:
                for j in np.flatnonzero(links[i] & columns_left).tolist():
                    columns_left[j] = False
                    out.append((i, j))
                    more = np.flatnonzero(links[:, j] & rows_left)
                    rows_left[more] = False
                    out += [(k, j) for k in more.tolist()]
                    following += more.tolist()
            front = following
    return out


def compare(assigned: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Rows (u, v, n): v null: u has n more links; else a link between u and v."""
    members = assigned.withColumn("cell", F.explode("cells"))
    blocks = members.groupBy("label", "dim", "cell").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    cut = members.join(blocks, ["label", "dim", "cell"]).withColumn("block", F.pmod(F.xxhash64("uid", "cell"), F.col("blocks")))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    names = ["label", "dim", "cell", "i", "j", "block", "uid", "weight", "vec", "cells"]
    placed = cut.select("label", "dim", "cell", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "uid", "weight", "vec", "cells")

    def of_group(key, rows):
        _, _, cell, i, j = key
        a = Block([r for r in rows if r["block"] == i], cell) if any(r["block"] == i for r in rows) else None
        b = a if i == j else Block([r for r in rows if r["block"] == j], cell) if any(r["block"] == j for r in rows) else None
        if a is None or b is None:
            return None
        links = linked(a, b, similarity)
        if i == j:
            np.fill_diagonal(links, False)
        counts = [(int(u), None, int(n)) for u, n in zip(a.uid, links @ b.weight) if n]
        if i != j:
            counts += [(int(u), None, int(n)) for u, n in zip(b.uid, a.weight @ links) if n]
        pairs = [(int(a.uid[x]), int(b.uid[y]), 0) for x, y in spanning(links)]
        return [*counts, *pairs]

    def run(batches):
        rows, last = [], None
        for batch in batches:
            for r in batch.to_pylist():
                key = tuple(r[c] for c in ("label", "dim", "cell", "i", "j"))
                if rows and key != last:
                    yield emit(of_group(last, rows))
                    rows = []
                last = key
                rows.append(r)
        if rows:
            yield emit(of_group(last, rows))

    def emit(found):
        return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found or ()], pa.int64()) for k in range(3)], names=["u", "v", "n"])

    keys = ["label", "dim", "cell", "i", "j"]
    return placed.select(*names).repartition(*keys).sortWithinPartitions(*keys, "uid").mapInArrow(run, "u long, v long, n long")


def near_duplicates(vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding", label: str = "label", similarity: float = SIMILARITY) -> DataFrame:
    """key, n_links, component_id, kept of every row."""
    rows = materialize(prepare(vectors, key, embedding, label), "vectors")
    classes = materialize(rows.filter(F.col("vec").isNotNull()).groupBy("label", "dim", "digest").agg(
        F.min("uid").alias("uid"), F.count("*").alias("weight"), F.first("vec").alias("vec")), "classes")
    found = materialize(compare(assign(classes, learn_cells(classes)), similarity), "found")
    counts = found.filter(F.col("v").isNull()).groupBy(F.col("u").alias("uid")).agg(F.sum("n").alias("n"))
    roots = connected(found.filter(F.col("v").isNotNull()).select("u", "v"))
    named = classes.select("label", "dim", "digest", F.col("uid").alias("class"), "weight").join(counts.withColumnRenamed("uid", "class"), "class", "left").join(
        roots.withColumnRenamed("node", "class"), "class", "left").select(
        "label", "dim", "digest", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("root", "class").alias("component"))
    joined = rows.drop("vec").join(named, ["label", "dim", "digest"], "left").withColumn("component", F.coalesce("component", "uid"))
    least = joined.groupBy("component").agg(F.min("key").alias("component_id"))
    return joined.join(least, "component").select(
        F.col("key").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id", F.col("key").eqNullSafe(F.col("component_id")).alias("kept"))
