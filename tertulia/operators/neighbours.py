"""Exact nearest neighbours inside chats, by blocks with bounds.

Vectors of a chat are dealt to chunks by a hash; inside a chunk a few rounds of
spherical k-means gather like vectors into blocks.  A block is one row: its
ids, its unit vectors, its centre and the widest angle from it.  Centres and
angles bound the cosine of any member of one block with any member of another,
from above and below, so that most blocks need not be looked at:

* a block of targets is sent to a chunk of queries only if for some query block
  its upper bound reaches the least cosine asked for, and also the cosine that
  the k best targets are sure to reach;
* a task reads the target blocks of its query chunk best first and leaves out
  products whose upper bound is below what all queries of a block have already.

A query chunk is sent once, a target block once to each query chunk that may
need it.  Only the k best of each query leave a task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import materialize

BLOCKS_PER_CHUNK = 32
ROUNDS = 4
SLACK = 1e-9  # bounds are compared with a little room for rounding
BLOCK = "chat_id long, chunk int, block int, n int, ids binary, vectors binary, centre binary, radius double"


def unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


def gathered(x: np.ndarray, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """Cell of each unit vector: spherical k-means from evenly spaced members."""
    centres = x[np.linspace(0, len(x) - 1, cells).astype(np.int64)]
    for _ in range(rounds):
        cell = (x @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, cell, x)
        centres = np.where(np.linalg.norm(sums, axis=1, keepdims=True) > 1e-12, unit(sums), centres)
    return (x @ centres.T).argmax(1)


def cone(x: np.ndarray) -> tuple[np.ndarray, float]:
    """Centre of some unit vectors and the widest angle from it; without a direction the angle is pi."""
    mean = x.sum(0)
    length = np.linalg.norm(mean)
    if length < 1e-9 or (np.abs(x).max(1) == 0).any():
        return np.eye(1, x.shape[1])[0], float(np.pi)
    centre = mean / length
    return centre, float(np.arccos(np.clip((x @ centre).min(), -1, 1)))


def blocks(vectors: DataFrame, chunk_rows: int) -> DataFrame:
    """The vectors (chat_id, id, embedding) as stored blocks."""
    sizes = vectors.groupBy("chat_id").agg(F.ceil(F.count("*") / chunk_rows).cast("int").alias("chunks"))
    dealt = vectors.join(sizes, "chat_id").withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))

    def pack(key, pdf):
        import pandas as pd

        pdf = pdf.sort_values("id")
        x = unit(np.stack(pdf["embedding"].to_numpy()).astype(np.float64))
        ids, rows = pdf["id"].to_numpy(), max(1, chunk_rows // BLOCKS_PER_CHUNK)
        cell = gathered(x, -(-len(x) // rows))
        out = []
        for c in np.unique(cell):
            at = np.flatnonzero(cell == c)
            for a in range(0, len(at), 2 * rows):
                own = at[a:a + 2 * rows]
                centre, radius = cone(x[own])
                out.append((key[0], key[1], len(out), len(own), ids[own].tobytes(), x[own].tobytes(), centre.tobytes(), radius))
        return pd.DataFrame(out, columns=[f.split()[0] for f in BLOCK.split(", ")])

    return materialize(dealt.select("chat_id", "chunk", "id", "embedding").groupBy("chat_id", "chunk").applyInPandas(pack, BLOCK), "blocks")


def between(c1: np.ndarray, r1: np.ndarray, c2: np.ndarray, r2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest cosine that members of each two blocks can have."""
    apart, reach = np.arccos(np.clip(c1 @ c2.T, -1, 1)), np.asarray(r1)[:, None] + np.asarray(r2)[None, :]
    return np.cos(np.minimum(np.pi, apart + reach)), np.cos(np.maximum(0, apart - reach))


def needed(q_centres, q_radii, t_centres, t_radii, t_sizes, k: int, least: float) -> np.ndarray:
    """Upper bound of each target block over the query blocks that may need it, -2 where none does."""
    low, high = between(q_centres, q_radii, t_centres, t_radii)
    order = np.argsort(-low, axis=1, kind="stable")
    held = np.cumsum(np.asarray(t_sizes)[order], axis=1)
    enough = (held >= k).argmax(1)
    sure = np.where(held[:, -1] >= k, np.take_along_axis(low, order, 1)[np.arange(len(low)), enough], -2.0)
    wanted = high >= np.maximum(sure, least)[:, None] - SLACK
    return np.where(wanted.any(0), np.where(wanted, high, -2.0).max(0), -2.0)


class Best:
    """The k best targets of the queries of one block so far; equal cosines go by id."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, centre: np.ndarray, radius: float, k: int):
        self.ids, self.x, self.centre, self.radius, self.k = ids, x, centre, radius, k
        self.sim, self.found = np.full((len(ids), k), -np.inf), np.full((len(ids), k), np.iinfo(np.int64).max)

    def offer(self, ids: np.ndarray, y: np.ndarray, centre: np.ndarray, radius: float, least: float) -> bool:
        """Compares with a block of targets, unless its bound shows that nothing in it can matter."""
        high = between(self.centre[None], [self.radius], centre[None], [radius])[1][0, 0]
        if high < max(least, self.sim[:, -1].min()) - SLACK:
            return False
        sim = np.concatenate([self.sim, np.round(self.x @ y.T, 12)], axis=1)
        found = np.concatenate([self.found, np.broadcast_to(ids, (len(self.ids), len(ids)))], axis=1)
        by_id = np.argsort(found, axis=1, kind="stable")
        order = np.take_along_axis(by_id, np.argsort(-np.take_along_axis(sim, by_id, 1), axis=1, kind="stable"), 1)[:, :self.k]
        self.sim, self.found = np.take_along_axis(sim, order, 1), np.take_along_axis(found, order, 1)
        return True


def nearest(queries: DataFrame, targets: DataFrame, k: int, chunk_rows: int, least: float) -> DataFrame:
    """chat_id, query_id, target_id, sim, place: of every query its k best targets of the chat that are at least ``least`` alike.

    queries: chat_id, query_id, embedding; targets: chat_id, target_id, embedding.
    """
    q = blocks(queries.select("chat_id", F.col("query_id").alias("id"), "embedding"), chunk_rows)
    t = blocks(targets.select("chat_id", F.col("target_id").alias("id"), "embedding"), chunk_rows)
    chunks = q.select("chat_id", F.col("chunk").alias("q_chunk")).distinct()
    cones = t.select("chat_id", "chunk", "block", "n", "centre", "radius").join(chunks, "chat_id")
    asked = q.select("chat_id", F.col("chunk").alias("q_chunk"), "centre", "radius")

    def choose(key, a, b):
        import pandas as pd

        if a.empty or b.empty:
            return pd.DataFrame(columns=["chat_id", "q_chunk", "chunk", "block", "high"])
        stack = lambda f: np.stack([np.frombuffer(c) for c in f["centre"]])
        high = needed(stack(a), a["radius"].to_numpy(), stack(b), b["radius"].to_numpy(), b["n"].to_numpy(), k, least)
        return b.assign(high=high)[["chat_id", "q_chunk", "chunk", "block", "high"]][high > -2.0]

    keys = ["chat_id", "q_chunk"]
    wanted = asked.groupBy(*keys).cogroup(cones.groupBy(*keys)).applyInPandas(choose, "chat_id long, q_chunk int, chunk int, block int, high double")
    sent = wanted.join(t, ["chat_id", "chunk", "block"]).select(*keys, F.lit(1).alias("side"), (-F.col("high")).alias("rank"), "chunk", "block", "ids", "vectors", "centre", "radius")
    own = q.select("chat_id", F.col("chunk").alias("q_chunk"), F.lit(0).alias("side"), F.lit(0.0).alias("rank"), "chunk", "block", "ids", "vectors", "centre", "radius")
    met = own.unionByName(sent).repartition(*keys).sortWithinPartitions(*keys, "side", "rank", "chunk", "block")

    def run(batches):
        of, held = None, []

        def out():
            for b in held:
                row, col = np.nonzero(b.sim >= least)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row), of[0])), pa.array(b.ids[row]), pa.array(b.found[row, col]), pa.array(b.sim[row, col]),
                                                  pa.array((col + 1).astype(np.int32))], names=["chat_id", "query_id", "target_id", "sim", "place"])

        for batch in batches:
            for r in batch.to_pylist():
                if (r["chat_id"], r["q_chunk"]) != of:
                    yield from out()
                    of, held = (r["chat_id"], r["q_chunk"]), []
                ids, centre = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["centre"])
                x = np.frombuffer(r["vectors"]).reshape(len(ids), -1)
                if r["side"] == 0:
                    held.append(Best(ids, x, centre, r["radius"], k))
                else:
                    for b in held:
                        b.offer(ids, x, centre, r["radius"], least)
        yield from out()

    return met.mapInArrow(run, "chat_id long, query_id long, target_id long, sim double, place int")
