"""Consistent-hash sharding with virtual nodes and bounded loads.

Rows hash to places on a ring; every shard has virtual nodes there.  A row
belongs to the next virtual node clockwise.  A shard takes no more rows than
its bound; rows beyond it go on clockwise to the next shard with room.  The
bounds add up to the number of rows, so counts differ by one at most, and with
one more shard only rows near its nodes or in overflowing arcs move.

The ring is cut into arcs.  Rows of an arc are alike, so who takes how many of
an arc's rows is worked out over the counts per arc (a fixed number), and a row
finds its shard and slot from its rank in the arc.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

ARCS = 1 << 16
NODES = 64  # virtual nodes of a shard
LAW = "rows"


def ring(shards: int, nodes: int = NODES, arcs: int = ARCS) -> tuple[np.ndarray, np.ndarray]:
    """Arcs at which virtual nodes stand, ascending, and their shards.  Of nodes at one arc the smaller hash keeps it."""
    at: dict[int, tuple[int, int]] = {}
    for s in range(shards):
        for v in range(nodes):
            h = zlib.crc32(f"node-{v}-of-shard-{s}".encode())
            arc, own = h % arcs, (h // arcs, s)
            at[arc] = min(at.get(arc, own), own)
    arcs_used = np.array(sorted(at))
    return arcs_used, np.array([at[a][1] for a in arcs_used])


def bounds(total: int, shards: int) -> np.ndarray:
    return np.array([total // shards + (s < total % shards) for s in range(shards)], np.int64)


def deal(counts: np.ndarray, shards: int, nodes: int = NODES) -> np.ndarray:
    """Who takes which rows of each arc: rows (arc, first rank, shard, first slot), sorted.

    Arcs are taken in the order of the ring, each by the next virtual node
    clockwise whose shard has room.
    """
    places, owner = ring(shards, nodes, len(counts))
    room, slot, out = bounds(int(counts.sum()), shards), np.zeros(shards, np.int64), []
    node_of = np.searchsorted(places, np.arange(len(counts))) % len(places)
    following = np.arange(1, len(places) + 1) % len(places)  # the next node whose shard may have room

    def open_node(k: int) -> int:
        path = []
        while not room[owner[k]]:
            path.append(k)
            k = following[k]
        for p in path:
            following[p] = k
        return int(k)

    missing = [s for s in range(shards) if s not in set(owner.tolist())]
    for arc in np.flatnonzero(counts):
        rank, left = 0, int(counts[arc])
        while left:
            if any(room[s] for s in set(owner.tolist())) if missing else True:
                s = int(owner[open_node(int(node_of[arc]))])
            else:
                s = next(s for s in missing if room[s])
            n = min(left, int(room[s]))
            out.append((arc, rank, s, slot[s]))
            room[s] -= n
            slot[s] += n
            rank, left = rank + n, left - n
    return np.array(out, np.int64).reshape(-1, 4)


def shard(docs: DataFrame, shards: int = 40, nodes: int = NODES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, size (bytes of the text, null: none, plus 16), text_crc32, law, shard, slot for every row.

    Equal rows are told apart by nothing, so any of them may get any of their
    slots.  A null key is a key like others; other columns are dropped.
    """
    arc = F.pmod(F.xxhash64(F.col(key)), F.lit(ARCS)).alias("_arc")
    counts = np.zeros(ARCS, np.int64)
    for r in docs.select(arc).groupBy("_arc").count().toLocalIterator():
        counts[r["_arc"]] = r["count"]
    dealt = deal(counts, shards, nodes)
    firsts = dealt[:, 0] * np.int64(1 << 40) + dealt[:, 1]
    body = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    rows = docs.select(F.col(key), (F.octet_length(body).cast("long") + 16).alias("size"), F.crc32(body).alias("text_crc32"), arc)
    ranked = rows.withColumn("_rank", F.row_number().over(W.partitionBy("_arc").orderBy(F.xxhash64(key), key, "text_crc32", "size")))
    schema = T.StructType([docs.schema[key], T.StructField("size", T.LongType()), T.StructField("text_crc32", T.LongType()),
                           T.StructField("law", T.StringType()), T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType()),
                           T.StructField("grown_shard", T.IntegerType())])

    def run(batches):
        for b in batches:
            arcs, rank = b.column("_arc").to_numpy(), b.column("_rank").to_numpy() - 1
            at = dealt[np.searchsorted(firsts, arcs * np.int64(1 << 40) + rank, "right") - 1]
            n = b.num_rows
            yield pa.RecordBatch.from_arrays(
                [b.column(key), b.column("size"), b.column("text_crc32"), pa.array([LAW] * n, pa.string()), pa.array(at[:, 2].astype(np.int32)),
                 pa.array(at[:, 3] + rank - at[:, 1]), pa.nulls(n, pa.int32())], names=schema.names)

    return ranked.mapInArrow(run, schema)
