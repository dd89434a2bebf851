"""Near-duplicate documents by Order MinHash with banded alignment.

Words are stretches without ASCII white space.  A text is the sequence of its
shingles of five words (one shorter shingle if it has fewer words), each
labelled with how often it occurred before in the text.  A sketch takes, under
one hash function, the few least labelled shingles and keeps them in text
order, so it agrees with the probability that texts share shingles in the same
order: it follows edit similarity.  Texts with an equal sketch in any of
``TABLES`` tables are candidates.

Candidates are verified by alignment: the longest chain of equal labelled
shingles that ascends in both texts, inside the band that the threshold leaves.
With a, b shingles and m matched ones, texts are linked if
m / (a + b - m) >= 0.8.

Equal word sequences form classes first, and only class representatives are
compared.  In every bucket the least member is compared with all others; only
where a bucket then still holds several groups are members of different groups
compared.  So a group of near copies costs
comparisons in proportion to its size, and every candidate pair of different
texts ends up linked, connected otherwise, or compared and refused.  The second
round works on blocks of a bucket and hands on only links that join groups.

Texts without words (null, empty, blank) are like nothing, not even each other.
Rows are told apart by a row number of the scan: the input must be a stored
table.  Of a group, the row with the least key (nulls first) stays, of equal
keys the first.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import materialize
from .common import binary, bytes_of, free_name, mix, numbered, signed, slices
from .links import connected

SHINGLE = 5
SIMILARITY = 0.8
TABLES = 36
# least number of shingles: shingles in a sketch.  Texts just above a bound have sketches of both sizes.
SKETCH_SIZES = {1: 1, 16: 4, 64: 8}
BLOCK = 256  # members of a bucket compared at once
COLUMNS = 4096
FILTER_BITS = 1 << 25
SLICE_BYTES = 1 << 20  # hashing needs about a hundred bytes of memory per byte of text
NULL_KEY = -(1 << 63)
_FACTORS = [np.uint64(f) for f in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
_SEEDS = mix(np.arange(1, TABLES + 1, dtype=np.uint64))[:, None]


def labelled_shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the labelled shingles of all texts of a batch, and where each text's begin (one more entry than texts)."""
    n = len(offsets) - 1
    dark = ~((data == 32) | ((data >= 9) & (data <= 13)))
    start = dark.copy()
    start[1:] &= ~dark[:-1]
    begins = offsets[:-1][offsets[:-1] < offsets[1:]]
    start[begins] = dark[begins]
    at = np.flatnonzero(start)
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    own = np.flatnonzero(dark)
    place = (own - at[np.cumsum(start)[own] - 1]).astype(np.uint64)
    word = mix(np.add.reduceat(mix(data[own].astype(np.uint64) + np.uint64(1) + (place << np.uint64(8))), np.searchsorted(own, at)))
    text = np.searchsorted(offsets, at, "right") - 1
    words = np.bincount(text, minlength=n)
    count = np.where(words > 0, np.maximum(words - SHINGLE + 1, 1), 0)
    bounds = np.concatenate([[0], np.cumsum(count)])
    of = np.repeat(np.arange(n), count)
    first = (np.cumsum(words) - words)[of] + np.arange(bounds[-1]) - bounds[of]
    end = np.cumsum(words)[of]
    h = np.zeros(len(of), np.uint64)
    for k, f in enumerate(_FACTORS):
        inside = first + k < end
        h += np.where(inside, word[np.minimum(first + k, len(word) - 1)], np.uint64(0)) * f
    h = mix(h)
    # label: how many equal shingles the text has before
    order = np.lexsort((h, of))
    new = np.ones(len(h), bool)
    new[1:] = (h[order[1:]] != h[order[:-1]]) | (of[order[1:]] != of[order[:-1]])
    if new.all():
        return h, bounds
    run = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
    label = np.empty(len(h), np.uint64)
    label[order] = (np.arange(len(h)) - run).astype(np.uint64)
    return mix(h + label * _FACTORS[0]), bounds


def sketches(shingles: np.ndarray) -> np.ndarray:
    """One key per table and sketch size of a text with shingles."""
    n, keys = len(shingles), []
    h = (shingles[None, :] ^ _SEEDS) * _FACTORS[1]
    h ^= h >> np.uint64(29)
    h *= _FACTORS[3]
    sizes = list(SKETCH_SIZES.items())
    for k, (least, size) in enumerate(sizes):
        above = sizes[k + 1][0] if k + 1 < len(sizes) else None
        if n < least or above and n * SIMILARITY >= above:
            continue
        size = min(size, n)
        picked = np.sort(np.argpartition(h, size - 1, axis=1)[:, :size], axis=1) if size < n else np.broadcast_to(np.arange(n), (TABLES, n))
        key = _SEEDS[:, 0] + np.uint64(least)
        for j in range(size):
            key = mix(key ^ shingles[picked[:, j]])
        keys.append(key)
    return np.concatenate(keys)


def chain_length(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """Most pairs (i, j), ascending in both, with a[i] == b[j] and |i - j| <= band; values are distinct within a and within b."""
    order = np.argsort(b)
    at = np.minimum(np.searchsorted(b[order], a), len(b) - 1)
    j = order[at]
    j = j[(b[j] == a) & (np.abs(j - np.arange(len(a))) <= band)]
    if not len(j) or (np.diff(j) > 0).all():
        return len(j)
    tails: list[int] = []
    for x in j.tolist():
        k = bisect_left(tails, x)
        tails[k:k + 1] = [x]
    return len(tails)


def alike(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> bool:
    total = len(a) + len(b)
    if not len(a) or not len(b) or min(len(a), len(b)) < similarity * max(len(a), len(b)):
        return False
    m = chain_length(a, b, int(total * (1 - similarity) / (1 + similarity)) + 1)
    return m >= similarity * (total - m)


def sketch(docs: DataFrame, key: str, text: str) -> DataFrame:
    """uid, ord (key, nulls first), digest of the words, number of shingles, sketch keys.  Narrow."""
    rows = numbered(docs, "uid", F.coalesce(F.col(key).cast("long"), F.lit(NULL_KEY)).alias("ord"), F.col(text).cast("binary").alias("body"))

    def run(batches):
        for whole in batches:
            for part in slices(whole, "body", SLICE_BYTES):
                column = binary(part.column("body"))
                shingles, bounds = labelled_shingles(*bytes_of(column))
                digests, keys, seen = [], [], {}
                for k, (uid, body) in enumerate(zip(part.column("uid").to_pylist(), column.to_pylist())):
                    own = shingles[bounds[k]:bounds[k + 1]]
                    if not len(own):
                        digests.append(b"row" + uid.to_bytes(8, "little")), keys.append([])
                        continue
                    d = hashlib.blake2b(b" ".join(body.split()), digest_size=16).digest()
                    if d not in seen:
                        seen[d] = signed(sketches(own))
                    digests.append(d), keys.append(seen[d])
                yield pa.RecordBatch.from_arrays(
                    [part.column("uid"), part.column("ord"), pa.array(digests, pa.binary()), pa.array(np.diff(bounds), pa.int64()), pa.array(keys, pa.list_(pa.int64()))],
                    names=["uid", "ord", "digest", "n", "keys"])

    return rows.mapInArrow(run, "uid long, ord long, digest binary, n long, keys array<long>")


def bodies_of(docs: DataFrame, text: str, wanted: DataFrame) -> DataFrame:
    """uid and body of the rows whose ``uid`` is in ``wanted``, and of few others, so that a join need not shuffle all texts.

    A bitmap of FILTER_BITS hashed row numbers goes to the tasks (4 MB however
    many there are; with very many it lets more rows through).
    """
    h = F.pmod(F.xxhash64("uid"), F.lit(FILTER_BITS)) + 1  # the bitmap functions count from 1
    marks = wanted.select(h.alias("h")).groupBy(F.bitmap_bucket_number("h").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("h")).alias("bits"))
    size = 1 << 12
    bitmap = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in marks.toLocalIterator():
        bitmap[(r["part"] - 1) * size:r["part"] * size] = np.frombuffer(bytes(r["bits"]), np.uint8)
    rows = numbered(docs, "uid", F.col(text).cast("binary").alias("body")).withColumn("h", h)

    def run(batches):
        for b in batches:
            bit = b.column("h").to_numpy() - 1
            on = (bitmap[bit >> 3] >> (bit & 7).astype(np.uint8) & 1).astype(bool)
            yield b.select(["uid", "body"]).filter(pa.array(on))

    return rows.mapInArrow(run, "uid long, body binary")


def verify(pairs: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """Of stored pairs (u, v) of row numbers those whose texts are alike."""
    first, second = (bodies_of(docs, text, pairs.select(F.col(c).alias("uid"))).withColumnsRenamed({"uid": c, "body": to}) for c, to in (("u", "a"), ("v", "b")))
    both = pairs.join(first, "u").join(second, "v")

    def run(batches):
        for whole in batches:
            for part in slices(whole, "a", SLICE_BYTES):
                (x, xb), (y, yb) = (labelled_shingles(*bytes_of(binary(part.column(c)))) for c in ("a", "b"))
                good = [alike(x[xb[k]:xb[k + 1]], y[yb[k]:yb[k + 1]]) for k in range(part.num_rows)]
                yield part.select(["u", "v"]).filter(pa.array(good, pa.bool_()))

    return both.select("u", "v", "a", "b").mapInArrow(run, "u long, v long")


def compare_all(uids: list[int], roots: list[int], blocks: list[int], bodies: list[bytes]) -> list[tuple[int, int]]:
    """Links that join different groups among the members of one block, or of two blocks (then across them only).

    Shared shingles of all pairs are counted by products of 0-1 matrices, some
    columns at a time; pairs that share enough are aligned unless already joined.
    """
    column = pa.array(bodies, pa.binary())
    shingles, bounds = labelled_shingles(*bytes_of(column))
    size, n = np.diff(bounds), len(uids)
    of = np.repeat(np.arange(n), size)
    _, slot, often = np.unique(shingles, return_inverse=True, return_counts=True)
    shared = often[slot] > 1
    slot, of = np.unique(slot[shared], return_inverse=True)[1], of[shared]
    order = np.argsort(slot, kind="stable")
    slot, of, common = slot[order], of[order], np.zeros((n, n), np.float32)
    for a in range(0, int(slot[-1]) + 1 if len(slot) else 0, COLUMNS):
        part = slice(*np.searchsorted(slot, [a, a + COLUMNS]))
        x = np.zeros((n, COLUMNS), np.float32)
        x[of[part], slot[part] - a] = 1
        common += x @ x.T
    block = np.array(blocks)
    across = block[:, None] != block[None, :] if (block != block[0]).any() else np.triu(np.ones((n, n), bool), 1)
    enough = (common >= SIMILARITY * (size[:, None] + size[None, :] - common) - 1e-3) & np.triu(across) & (np.array(roots)[:, None] != np.array(roots)[None, :])
    parent: dict[int, int] = {}

    def root(r: int) -> int:
        while (up := parent.get(r, r)) != r:
            r = up
        return r

    out = []
    for i, j in np.argwhere(enough).tolist():
        a, b = root(roots[i]), root(roots[j])
        if a != b and alike(shingles[bounds[i]:bounds[i + 1]], shingles[bounds[j]:bounds[j + 1]]):
            parent[max(a, b)] = min(a, b)
            out.append((uids[i], uids[j]))
    return out


def settle_blocks(members: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """Links (u, v) between different groups inside buckets, given bucket, uid, root, the bucket's size, its largest group (top) and that group's size.

    Buckets are cut into blocks of about BLOCK members, those of the largest
    group first; a task compares one block with itself or with another one.
    Blocks of the largest group meet only blocks of other groups, so a huge
    group with few strangers costs in proportion to its size.
    """
    body = bodies_of(docs, text, members.select("uid"))
    big, rest = F.ceil(F.col("top_size") / BLOCK), F.ceil((F.col("size") - F.col("top_size")) / BLOCK)
    at_top, spread = F.col("root") == F.col("top"), F.xxhash64("uid", "bucket")
    cut = members.withColumn("block", F.when(at_top, F.pmod(spread, big)).otherwise(big + F.pmod(spread, rest))).withColumn(
        "other", F.explode(F.sequence(F.when(at_top, big).otherwise(F.lit(0).cast("long")), big + rest - 1)))
    placed = cut.select("bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "uid", "root").join(body, "uid")
    names = ["bucket", "i", "j", "uid", "root", "block", "body"]

    def run(batches):
        rows, last = [], None

        def out():
            found = compare_all(*zip(*[r[3:] for r in rows]))
            return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["u", "v"])

        for b in batches:
            for r in zip(*(b.column(c).to_pylist() for c in names)):
                if rows and r[:3] != last:
                    yield out()
                    rows = []
                last = r[:3]
                rows.append(r)
        if rows:
            yield out()

    return placed.select(*names).repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "uid").mapInArrow(run, "u long, v long")


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """uid, ord, class_uid (first row with the same words) and root (the group's first row) of every row."""
    rows = materialize(sketch(docs, key, text), "sketches")
    first = F.min(F.struct("ord", "uid", "n", "keys")).alias("f")
    classes = materialize(rows.groupBy("digest").agg(first).select("digest", "f.*"), "classes")
    # numbers in the order of the keys, so that the least number of a group is its first row: ord ties are broken by uid
    members = classes.select(F.explode("keys").alias("bucket"), "ord", "uid", "n")
    hubs = members.groupBy("bucket").agg(F.min(F.struct("ord", "uid", "n")).alias("h"), F.count("*").alias("size")).filter("size > 1")
    close = lambda a, b: F.least(a, b) >= F.greatest(a, b) * SIMILARITY
    shared = materialize(members.join(hubs, "bucket").select("bucket", "ord", "uid", "n", F.col("h.uid").alias("hub"), F.col("h.n").alias("hub_n")), "buckets")
    stars = materialize(shared.filter((F.col("uid") != F.col("hub")) & close(F.col("n"), F.col("hub_n"))).select(F.col("hub").alias("u"), F.col("uid").alias("v")).distinct(), "pairs")
    links = materialize(verify(stars, docs, text), "links")
    roots = connected(links)
    # the hub of a bucket was compared with all others; left are buckets whose other members are of several groups
    named = shared.filter(F.col("uid") != F.col("hub")).join(roots, F.col("uid") == roots["node"], "left").select("bucket", "uid", F.coalesce("root", "uid").alias("root"))
    signs = [F.bit_xor(F.xxhash64("uid", F.lit(k))).alias(f"sign{k}") for k in (1, 2)]
    per_group = named.groupBy("bucket", "root").agg(F.count("*").alias("c"), *signs)
    mixed = per_group.groupBy("bucket").agg(
        F.sum("c").alias("size"), F.max(F.struct("c", "root")).alias("top"), F.count("*").alias("groups"), *[F.bit_xor(f"sign{k}").alias(f"sign{k}") for k in (1, 2)])
    # several tables often put the same members together: buckets of one member set (128-bit hash) are settled once
    settled = mixed.filter("groups > 1").groupBy("size", "sign1", "sign2").agg(F.min(F.struct("bucket", "top")).alias("b")).select(
        "b.bucket", "size", F.col("b.top.root").alias("top"), F.col("b.top.c").alias("top_size"))
    open_members = materialize(named.join(settled, "bucket"), "mixed")
    more = materialize(settle_blocks(open_members, docs, text), "links")
    roots = connected(links.unionByName(more)) if not more.isEmpty() else roots
    grouped = classes.join(roots, classes["uid"] == roots["node"], "left").select(
        "digest", "ord", F.col("uid").alias("class_uid"), F.coalesce("root", "uid").alias("component"))
    least = grouped.groupBy("component").agg(F.min(F.struct("ord", "class_uid")).alias("least"))
    named_classes = grouped.join(least, "component").select("digest", "class_uid", F.col("ord").alias("class_ord"), F.col("least.ord").alias("root_ord"), F.col("least.class_uid").alias("root"))
    return rows.select("uid", "ord", "digest").join(named_classes, "digest").drop("digest")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, copy_of (first key with the same words), cluster_id (least key of the group), kept (first row of the group)."""
    shown = lambda c: F.when(F.col(c) != NULL_KEY, F.col(c))
    return groups(docs, key, text).select(
        shown("ord").alias(key), shown("class_ord").alias("copy_of"), shown("root_ord").alias("cluster_id"), (F.col("uid") == F.col("root")).alias("kept"))


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are the first of their group, unchanged."""
    uid = free_name(docs, "uid")
    dropped = groups(docs, key, text).filter(F.col("uid") != F.col("root")).select(F.col("uid").alias(uid))
    return numbered(docs, uid, "*").join(dropped, uid, "left_anti").drop(uid)
