"""What the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

SLICE_BYTES = 4 << 20
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once per row, also where lambdas read it again and again."""
    return F.transform(F.array(value), use)[0]


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores added until the table has no such column (names differ in more than case)."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted


def numbered(stored: DataFrame, name: str, *columns: Column | str) -> DataFrame:
    """``name``, the row's number in the scan of a stored table, and ``columns``.

    A scan cuts files by the cores registered when it is planned.  The session
    keeps the first such number, so that a table read twice has the same row
    numbers although executors came or went in between.
    """
    spark = stored.sparkSession
    if not spark.conf.get("spark.sql.files.minPartitionNum", None):
        spark.conf.set("spark.sql.files.minPartitionNum", str(spark.sparkContext.defaultParallelism))
    return stored.select(F.monotonically_increasing_id().alias(name), *columns)


def small_batches(df: DataFrame) -> DataFrame:
    """``df``; its session from now on hands at most about BATCH_BYTES to Python at once.

    By default a batch has up to 10000 rows, which is much memory on both sides where texts are long.
    """
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if _bytes(conf.get(name)) > BATCH_BYTES:
        conf.set(name, str(BATCH_BYTES))
    return df


def _bytes(setting: str) -> int:
    """Bytes of a size setting such as 64MB."""
    digits = setting.lower().rstrip("bkmgt ")
    unit = setting.lower()[len(digits):].strip().rstrip("b")
    return int(digits) << {"": 0, "k": 10, "m": 20, "g": 30, "t": 40}[unit]


def binary(column: pa.Array) -> pa.Array:
    """Text as UTF-8 bytes, null as empty."""
    if pa.types.is_null(column.type):
        return pa.array([b""] * len(column), pa.binary())
    return column.cast(pa.binary()).fill_null(b"")


def slices(batch: pa.RecordBatch, name: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch so that a slice has about ``limit`` bytes of the column, or one row."""
    if not batch.num_rows:
        return
    _, offsets = bytes_of(binary(batch.column(name)))
    start = 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1)
        yield batch.slice(start, end - start)
        start = end


def neighbours(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Stretches of batches whose rows have the same values in the named whole-number columns, with these values."""
    for whole in batches:
        if not whole.num_rows:
            continue
        k = np.stack([whole.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in names])
        cuts = np.flatnonzero((k[:, 1:] != k[:, :-1]).any(0)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), whole.num_rows]):
            yield tuple(k[:, a].tolist()), whole.slice(a, b - a)


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column without nulls in one array, and where each row starts (one more entry than rows)."""
    _, starts, data = column.buffers()
    offsets = np.frombuffer(starts, np.int32, len(column) + 1, column.offset * 4).astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0]:offsets[-1]], offsets - offsets[0]


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values (a finaliser with odd multipliers and shifts)."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def signed(h: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(h).view(np.int64)
