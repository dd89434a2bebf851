"""Removal of byte strings that occur earlier in the corpus, by prefix-free parsing.

A string of ``length`` bytes that also starts earlier (in a smaller document,
or before in the same one) is repeated; all bytes that repeated strings cover
are removed.  Matches never cross documents and are judged on the input.

1. Parsing.  A rolling hash over ``TRIGGER`` bytes slides over each text.  The
   trigger of a string is the leftmost place of the least hash inside it, so
   equal strings have the same trigger at the same place, and runs of following
   strings share one.  The text of such a run is a phrase: at most 2 x length
   bytes around its trigger, about one phrase per 35 bytes.
2. Dictionary.  Phrases meet by trigger and content.  Every occurrence of a
   phrase but the first is repeated whole.  A trigger with one phrase only holds
   nothing repeated besides.  This settles nearly all text, by two hashes per
   phrase (128 bits together).
3. Suffix order.  Only phrases whose trigger has several different phrases are
   left, once each.  The strings that start in them, all suffixes of phrases cut
   at ``length`` bytes, are sorted bytewise, equal ones in the order of the
   corpus; neighbours that agree in all bytes are equal, and all but the first
   of them are repeated.  Strings meet by the 78 bytes around the trigger that
   strings at nearly the same distance from it share, so that a common trigger
   in different surroundings is many small groups.  A group of more than
   ``CHUNK`` strings (a common passage in different surroundings) is not
   gathered: its strings meet by two hashes of all their bytes (128 bits
   together), so that only equal ones come together, and are read as a stream.
4. The covered bytes of each document are joined and cut out.

Texts are hashed some hundred kilobytes at a time, a very long one in
stretches, so a text of any length needs little more memory than its own bytes.
Phrases travel in rows sorted inside tasks and are read as a stream, so a
frequent trigger needs no memory; equal phrases of one batch are merged before
the shuffle.  Rows are told apart by a row number of the scan, so the input must
be a stored table (or another plan that gives the same rows in the same
partitions each time).

Null texts count as empty.  Rows with the same key are different documents, in
the order of the scan; null keys come first.  Empty tables give empty results.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ..session import materialize
from .common import binary, bytes_of, free_name, mix, numbered, signed, slices, small_batches

LENGTH = 100
TRIGGER = 32
BASE, SECOND = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F  # odd factors of the rolling hashes
FAMILY = 23  # strings whose trigger is at nearly the same distance are compared together
CHUNK = 200_000  # strings sorted at once; larger groups are settled string by string
OPEN_BYTES = 1 << 18  # bytes of phrases cut into strings at once
PARSE_BYTES = 1 << 18  # bytes of text hashed at once, which takes about a hundred bytes for each
DIGEST_BYTES = 1 << 20  # bytes of text written at once
CUT_ROWS = 20_000  # phrases cut out of texts at once
_MASK = (1 << 64) - 1


def _powers(factor: int, n: int) -> np.ndarray:
    """factor ** 0 .. factor ** n modulo 2 ** 64."""
    out = np.ones(n + 1, np.uint64)
    filled, step = 1, factor & _MASK
    while filled <= n:
        take = min(filled, n + 1 - filled)
        out[filled:filled + take] = out[:take] * np.uint64(step)
        step, filled = step * step & _MASK, filled + take
    return out


class Rolling:
    """Hashes of any stretch of some bytes, from running sums."""

    def __init__(self, data: np.ndarray, factor: int):
        inverse = pow(factor, -1, 1 << 64)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(factor, len(data))[:-1] if len(data) else data.astype(np.uint64), out=self.sums[1:])
        self.back = _powers(inverse, len(data))

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.back[start])


def triggers(data: np.ndarray, rolling: Rolling, length: int = LENGTH) -> np.ndarray:
    """For every start of a string of ``length`` bytes: where the leftmost least hash inside it is."""
    n, width = len(data) - length + 1, length - TRIGGER + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    at = np.arange(len(data) - TRIGGER + 1)
    h = rolling.of(at, at + TRIGGER) >> np.uint64(7)
    # least value of a sliding window from the least of blocks' ends and beginnings; the place in the block breaks ties
    blocks = -(-len(h) // width)
    v = np.full(blocks * width, _MASK, np.uint64)
    v[:len(h)] = h << np.uint64(7)
    v = v.reshape(blocks, width)
    v[:] |= np.arange(width, dtype=np.uint64)
    ends = np.minimum.accumulate(v[:, ::-1], axis=1)[:, ::-1].ravel()[:n]
    starts = np.minimum.accumulate(v, axis=1).ravel()[width - 1:width - 1 + n]
    place = np.arange(n)
    block = place // width * width
    left = (ends >> np.uint64(7)) <= (starts >> np.uint64(7))
    inside = np.where(left, ends, starts) & np.uint64(127)
    return np.where(left, block, (place + width - 1) // width * width) + inside.astype(np.int64)


def parse(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH) -> dict[str, np.ndarray]:
    """Phrases of a batch of texts: row, first string's start (in its text), number of strings, trigger's distance, two hashes."""
    none = {k: np.zeros(0, np.int64) for k in ("row", "start", "strings", "distance", "trigger", "phrase")}
    if len(data) < length:
        return none
    first = Rolling(data, BASE)
    of = triggers(data, first, length)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:len(of)]
    whole = np.flatnonzero(np.arange(len(of)) + length <= offsets[row + 1])
    if not len(whole):
        return none
    new = np.ones(len(whole), bool)
    new[1:] = (of[whole[1:]] != of[whole[:-1]]) | (row[whole[1:]] != row[whole[:-1]])
    begin = np.flatnonzero(new)
    strings = np.diff(np.append(begin, len(whole)))
    start = whole[begin]
    place, row = of[start], row[start]
    trigger = signed(first.of(place, place + TRIGGER))
    del of, whole, new, first
    phrase = Rolling(data, SECOND).of(start, start + strings + length - 1)
    distance = place - start
    return {"row": row, "start": start - offsets[row], "strings": strings, "distance": distance,
            "trigger": trigger,
            "phrase": signed(mix(phrase ^ (strings.astype(np.uint64) << np.uint64(8) | distance.astype(np.uint64))))}


def stretches(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH):
    """Texts to parse at once, with the place where they start in their text: one very long text comes in stretches.

    A stretch holds the strings that start in it whole.  A run of strings that
    a border cuts is two phrases, which step 3 compares string by string.
    """
    if len(offsets) != 2 or len(data) <= 2 * PARSE_BYTES:
        yield data, offsets, 0
        return
    for a in range(0, len(data) - length + 1, PARSE_BYTES):
        part = data[a:a + PARSE_BYTES + length - 1]
        yield part, np.array([0, len(part)]), a


def _numbered(docs: DataFrame, key: str, text: str) -> DataFrame:
    return numbered(docs, "uid", F.col(key).cast("long").alias("key"), F.col(text).cast("binary").alias("body")).select("key", "uid", "body")


PHRASES = "route long, trigger long, phrase long, key long, uid long, start long, shape int, settled boolean"


def phrases(numbered: DataFrame, length: int = LENGTH) -> DataFrame:
    """Step 1.  ``settled`` rows repeat a phrase of the same batch; their route spreads them over the tasks."""

    def run(batches):
        for whole in batches:
            for part in slices(whole, "body", PARSE_BYTES):
                for data, offsets, base in stretches(*bytes_of(binary(part.column("body"))), length):
                    yield found(part, parse(data, offsets, length), base)

    def found(part, p, base):
        key = part.column("key").fill_null(-(1 << 63)).to_numpy()[p["row"]]
        uid = part.column("uid").to_numpy()[p["row"]]
        order = np.lexsort((p["start"], uid, key, p["phrase"], p["trigger"]))
        same = np.zeros(len(order), bool)
        t, q = p["trigger"][order], p["phrase"][order]
        same[1:] = (t[1:] == t[:-1]) & (q[1:] == q[:-1])
        key, uid, start = key[order], uid[order], p["start"][order] + base
        route = np.where(same, signed(mix(uid.astype(np.uint64) + start.astype(np.uint64))), t)
        shape = (p["strings"][order] * 128 + p["distance"][order]).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (route, t, q, key, uid, start, shape, same)],
                                          names=["route", "trigger", "phrase", "key", "uid", "start", "shape", "settled"])

    return small_batches(numbered).mapInArrow(run, PHRASES)


FOUND = "trigger long, key long, uid long, start long, shape int, settled boolean"


def meet(parsed: DataFrame) -> DataFrame:
    """Step 2: repeated phrases (``settled``), and first occurrences of phrases whose trigger has several.

    Each task reads its rows in order of trigger, phrase and place, holding one row back.
    """
    names = ["trigger", "key", "uid", "start", "shape"]

    def run(batches):
        last, held, shared = None, None, False  # trigger and phrase; the trigger's only phrase so far; whether it has more

        def out(columns, settled):
            return pa.RecordBatch.from_arrays([*(pa.array(c) for c in columns), pa.array(np.full(len(columns[0]), settled))], names=[*names, "settled"])

        for b in batches:
            if not b.num_rows:
                continue
            known = b.column("settled").to_numpy(zero_copy_only=False)
            c = {n: b.column(n).to_numpy() for n in [*names, "phrase"]}
            if known.any():
                yield out([c[n][known] for n in names], True)
            c = {n: v[~known] for n, v in c.items()}
            t, q = c["trigger"], c["phrase"]
            if not len(t):
                continue
            again = np.zeros(len(t), bool)
            again[1:] = (t[1:] == t[:-1]) & (q[1:] == q[:-1])
            again[0] = last == (t[0], q[0])
            if again.any():
                yield out([c[n][again] for n in names], True)
            firsts = {n: c[n][~again] for n in names}
            ft = firsts["trigger"]
            if len(ft):
                more = np.zeros(len(ft), bool)
                more[1:] |= ft[1:] == ft[:-1]
                more[:-1] |= ft[:-1] == ft[1:]
                if last is not None and last[0] == ft[0]:
                    more[0] = True
                    if held is not None:
                        yield out([np.array([v]) for v in held], False)
                        held = None
                elif held is not None:
                    held = None
                ready = more.copy()
                if not more[-1]:  # the next batch may bring another phrase of this trigger
                    held = tuple(firsts[n][-1] for n in names)
                else:
                    held = None
                if ready.any():
                    yield out([firsts[n][ready] for n in names], False)
            last = (t[-1], q[-1])

    by_route = parsed.repartition("route").sortWithinPartitions("trigger", "phrase", "key", "uid", "start")
    return by_route.mapInArrow(run, FOUND)


def sort_suffixes(bodies: list[bytes], strings: np.ndarray, group: np.ndarray, length: int = LENGTH) -> list[np.ndarray]:
    """Step 3 for whole groups of phrases in corpus order: which strings of each phrase are equal to an earlier one of the group."""
    total = int(strings.sum())
    data = np.frombuffer(b"".join(bodies), np.uint8)
    begin = np.cumsum([0, *[len(b) for b in bodies[:-1]]])
    phrase = np.repeat(np.arange(len(bodies)), strings)
    start = begin[phrase] + np.arange(total) - (np.cumsum(strings) - strings)[phrase]
    keys = np.empty((total, length + 4), np.uint8)
    keys[:, :4] = group[phrase].astype(">u4").view(np.uint8).reshape(-1, 4)
    keys[:, 4:] = np.lib.stride_tricks.sliding_window_view(data, length)[start]
    order = np.argsort(keys.view(f"S{length + 4}").ravel(), kind="stable") if not (keys[:, -1] == 0).any() else np.lexsort(keys.T[::-1])
    equal = np.zeros(total, bool)
    equal[order[1:]] = (keys[order[1:]] == keys[order[:-1]]).all(axis=1)
    return np.split(equal, np.cumsum(strings)[:-1])


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def resolve(numbered: DataFrame, open_phrases: DataFrame, length: int = LENGTH) -> DataFrame:
    """Step 3: covered stretches (uid, start, end) from phrases that share a trigger with others."""
    wanted = open_phrases.groupBy("uid").agg(F.collect_list(F.struct("trigger", "start", "shape")).alias("wanted"))
    texts = numbered.join(wanted, "uid")

    def cut(batches):
        for whole in batches:
            for part in slices(whole, "body", PARSE_BYTES):
                rows = []
                for key, uid, body, wanted in zip(*(part.column(c).to_pylist() for c in ("key", "uid", "body")), part.column("wanted")):
                    fields = wanted.values.flatten()
                    for begin, shape in zip(fields[1].to_numpy(), fields[2].to_numpy()):
                        strings, distance = divmod(int(shape), 128)
                        place = int(begin) + distance
                        if len(rows) >= CUT_ROWS:
                            yield pieces(rows)
                            rows = []
                        for low in range(0, length - TRIGGER + 1, FAMILY):
                            high = low + FAMILY - 1  # strings whose trigger is low to high bytes in share these bytes:
                            far, near = min(distance, high), max(distance - strings + 1, low)
                            if far >= near:
                                common = body[max(place - low, 0):place + length - high]
                                group = int.from_bytes(hashlib.blake2b(common, digest_size=8, salt=bytes([low])).digest(), "little", signed=True)
                                rows.append((group, key, uid, place - far, far - near + 1, body[place - far:place - near + length]))
                if rows:
                    yield pieces(rows)

    def pieces(rows):
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows), kinds)], names=["group", "key", "uid", "start", "strings", "phrase"])

    cuts = small_batches(texts).mapInArrow(cut, "group long, key long, uid long, start long, strings int, phrase binary")

    names = ["group", "key", "uid", "start", "strings", "phrase"]
    schema = "uid long, start long, end long, key long, strings int, phrase binary"
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())

    def batch(rows):
        columns = list(zip(*rows)) or [()] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["uid", "start", "end", "key", "strings", "phrase"])

    def settle(rows):
        """Whole groups only."""
        groups, _, uids, starts, strings, bodies = zip(*rows)
        _, group = np.unique(np.array(groups), return_inverse=True)
        found = sort_suffixes(bodies, np.array(strings), group, length)
        return batch([(u, s + a, s + b + length - 1, None, None, None) for u, s, flags in zip(uids, starts, found) for a, b in _runs(flags)])

    def run(batches):
        """Covered stretches of groups of at most CHUNK strings, and the phrases of larger ones (without ``end``)."""
        rows, count = [], 0
        first, inside, large = 0, 0, None  # the last group held: its first row and number of strings; the group that is handed on
        for b in batches:
            loose = []
            for row in zip(*(b.column(c).to_pylist() for c in names)):
                if row[0] != large:
                    if not rows or rows[-1][0] != row[0]:
                        if count >= CHUNK:
                            yield settle(rows)
                            rows, count = [], 0
                        first, inside = len(rows), 0
                    rows.append(row)
                    count, inside = count + row[4], inside + row[4]
                    if inside <= CHUNK:
                        continue
                    large, count = row[0], count - inside
                    loose += rows[first:]
                    del rows[first:]
                else:
                    loose.append(row)
            if loose:
                yield batch([(uid, start, None, key, strings, phrase) for _, key, uid, start, strings, phrase in loose])
        if rows:
            yield settle(rows)

    by_group = cuts.repartition("group").sortWithinPartitions("group", F.col("key").asc_nulls_first(), "uid", "start")
    sorted_out = materialize(by_group.mapInArrow(run, schema), "groups")
    rest = equal_strings(sorted_out.filter(F.col("end").isNull()).select("key", "uid", "start", "strings", "phrase"), length)
    return sorted_out.filter(F.col("end").isNotNull()).select("uid", "start", "end").unionByName(rest)


def equal_strings(pieces: DataFrame, length: int = LENGTH) -> DataFrame:
    """Covered stretches (uid, start, end) from phrases whose groups are large: every string meets its equals only.

    As in steps 1 and 2, equal strings of one batch are settled before the
    shuffle, and a task reads its rows in order, whatever the number of equals.
    """

    def cut(batches):
        for whole in batches:
            for part in slices(whole, "phrase", OPEN_BYTES):
                data, offsets = bytes_of(binary(part.column("phrase")))
                strings = part.column("strings").to_numpy()
                piece = np.repeat(np.arange(len(strings)), strings)
                inside = np.arange(len(piece)) - (np.cumsum(strings) - strings)[piece]
                at = offsets[piece] + inside
                one, two = (signed(Rolling(data, f).of(at, at + length)) for f in (BASE, SECOND))
                key = part.column("key").fill_null(-(1 << 63)).to_numpy()[piece]
                uid, start = part.column("uid").to_numpy()[piece], part.column("start").to_numpy()[piece] + inside
                order = np.lexsort((start, uid, key, two, one))
                one, two, key, uid, start = (x[order] for x in (one, two, key, uid, start))
                same = np.zeros(len(order), bool)
                same[1:] = (one[1:] == one[:-1]) & (two[1:] == two[:-1])
                route = np.where(same, signed(mix(uid.astype(np.uint64) + start.astype(np.uint64))), one)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (route, one, two, key, uid, start, same)],
                                                 names=["route", "one", "two", "key", "uid", "start", "settled"])

    def meet_equals(batches):
        last = None
        for b in batches:
            if not b.num_rows:
                continue
            known = b.column("settled").to_numpy(zero_copy_only=False)
            one, two = (b.column(c).to_numpy()[~known] for c in ("one", "two"))
            again = known.copy()
            if len(one):
                equal = np.zeros(len(one), bool)
                equal[1:] = (one[1:] == one[:-1]) & (two[1:] == two[:-1])
                equal[0] = last == (one[0], two[0])
                again[~known] = equal
                last = (one[-1], two[-1])
            yield pa.RecordBatch.from_arrays([pa.array(b.column(c).to_numpy()[again]) for c in ("uid", "start")], names=["uid", "start"])

    def join(batches):
        """Strings that overlap or touch become one stretch; the last one is held back."""
        held = None
        for b in batches:
            if not b.num_rows:
                continue
            uid, start = b.column("uid").to_numpy(), b.column("start").to_numpy()
            new = np.ones(len(uid), bool)
            new[1:] = (uid[1:] != uid[:-1]) | (start[1:] > start[:-1] + length)
            begin = np.flatnonzero(new)
            uids, starts, ends = uid[begin], start[begin], start[np.append(begin[1:], len(uid)) - 1] + length
            if held and held[0] == uids[0] and held[2] >= starts[0]:
                starts = np.append(held[1], starts[1:])
            elif held:
                uids, starts, ends = (np.append(h, x) for h, x in zip(held, (uids, starts, ends)))
            held = (uids[-1], starts[-1], ends[-1])
            yield pa.RecordBatch.from_arrays([pa.array(x[:-1]) for x in (uids, starts, ends)], names=["uid", "start", "end"])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([h], pa.int64()) for h in held], names=["uid", "start", "end"])

    strings = pieces.mapInArrow(cut, "route long, one long, two long, key long, uid long, start long, settled boolean")
    met = strings.repartition("route").sortWithinPartitions("one", "two", "key", "uid", "start").mapInArrow(meet_equals, "uid long, start long")
    return met.repartition("uid").sortWithinPartitions("uid", "start").mapInArrow(join, "uid long, start long, end long")


def covered(numbered: DataFrame, length: int = LENGTH) -> DataFrame:
    """All covered stretches of all rows, as an array ``spans`` of (start, end) per uid; they may overlap."""
    found = materialize(meet(phrases(numbered, length)), "phrases")
    whole = found.filter("settled").select("uid", "start", (F.col("start") + F.floor(F.col("shape") / 128) + (length - 1)).alias("end"))
    rest = resolve(numbered, found.filter(~F.col("settled")), length)
    return whole.unionByName(rest).groupBy("uid").agg(F.collect_list(F.struct("start", "end")).alias("spans"))


def join_spans(spans: pa.ListScalar) -> list[tuple[int, int]]:
    """Maximal stretches, ascending, of a list of (start, end); null gives none."""
    if not spans.is_valid or not len(spans.values):
        return []
    start, end = (c.to_numpy() for c in spans.values.flatten())
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > end[:-1]
    first = np.flatnonzero(new)
    return list(zip(start[first].tolist(), end[np.append(first[1:], len(start)) - 1].tolist()))


def kept_bytes(body: bytes, spans: list[tuple[int, int]]) -> bytes:
    at, out = 0, []
    for a, b in spans:
        out.append(body[at:a])
        at = b
    return b"".join([*out, body[at:]])


def digest(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """key, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    numbered = _numbered(docs, key, text)
    joined = numbered.join(covered(numbered, length), "uid", "left")

    def run(batches):
        for whole in batches:
            for part in slices(whole, "body", DIGEST_BYTES):
                size, removed, count, sha = [], [], [], []
                for body, spans in zip(binary(part.column("body")).to_pylist(), part.column("spans")):
                    spans = join_spans(spans)
                    size.append(len(body)), removed.append(sum(b - a for a, b in spans)), count.append(len(spans))
                    sha.append(hashlib.sha256(kept_bytes(body, spans)).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [part.column("key"), *(pa.array(x, pa.int64()) for x in (size, removed, count)), pa.array(sha, pa.string())],
                    names=[key, "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    schema = T.StructType([T.StructField(key, T.LongType()), *[T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")],
                           T.StructField("kept_sha256", T.StringType())])
    return small_batches(joined).mapInArrow(run, schema)


def whole_characters(body: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Stretches shrunk to characters that lie inside them."""
    out = []
    for a, b in spans:
        while a < b and body[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(body) and body[b] & 0xC0 == 0x80:
            b -= 1
        if b > a:
            out.append((a, b))
    return out


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", chars: str | None = None, length: int = LENGTH) -> DataFrame:
    """``docs`` with the repeated stretches cut out of the text (whole characters only).

    ``chars`` names a column to set to the new length of the text.  Null texts stay null.
    """
    uid, spans = free_name(docs, "uid"), free_name(docs, "spans")
    found = covered(_numbered(docs, key, text), length).withColumnsRenamed({"uid": uid, "spans": spans})
    joined = numbered(docs, uid, "*").join(found, uid, "left")
    names = docs.columns

    def run(batches):
        for whole in batches:
            for part in slices(whole, text, DIGEST_BYTES):
                texts = part.column(text).to_pylist()
                new = []
                for t, s in zip(texts, part.column(spans)):
                    body = (t or "").encode("utf-8", "surrogatepass")
                    new.append(kept_bytes(body, whole_characters(body, join_spans(s))).decode("utf-8", "replace") if s.is_valid else t)
                size = pa.array([len(t or "") for t in new], pa.int64())
                columns = {c: part.column(c) for c in names} | {text: pa.array(new, pa.string())}
                if chars:
                    columns[chars] = size.cast(part.column(chars).type)
                yield pa.RecordBatch.from_arrays([columns[c] for c in names], names=names)

    return small_batches(joined).mapInArrow(run, docs.schema)
