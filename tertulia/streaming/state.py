"""State of streams kept as small tables, and rows that come too late.

A ``StateTable`` holds one row per key.  Every batch writes the whole table anew
from the version before it and what the batch brought, as a version of its own,
and takes older versions away: the table's size depends on its keys, not on how
many batches there were.  A batch that is run again starts from the version
before it once more, so it leaves the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


class StateTable:
    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path, schema
        self._folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        self._files = self._folder.getFileSystem(spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """Batches whose whole table is there, ascending."""
        if not self._files.exists(self._folder):
            return []
        found = [(f.getPath().getName(), f.getPath()) for f in self._files.listStatus(self._folder)]
        done = [int(name.split("=")[1]) for name, p in found
                if name.startswith("version=") and self._files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return sorted(done)

    def _read(self, version: int | None) -> DataFrame:
        if version is None:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/version={version}")

    def before(self, batch: int) -> DataFrame:
        """The table as the batches before this one left it."""
        return self._read(max((v for v in self.versions() if v < batch), default=None))

    def latest(self) -> DataFrame:
        return self._read(max(self.versions(), default=None))

    def write(self, batch: int, table: DataFrame) -> None:
        """The table after this batch; the version before it stays for a batch that is run again."""
        table.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/version={batch}")
        for old in [v for v in self.versions() if v < batch][:-1]:
            self._files.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/version={old}"), True)

    def merge(self, batch: int, news: DataFrame, key: str, how: dict[str, Callable[[str], Column]]) -> None:
        """Adds ``news`` (rows like the table's) with one aggregate per column."""
        both = self.before(batch).unionByName(news)
        self.write(batch, both.groupBy(key).agg(*[f(c).alias(c) for c, f in how.items()]))


def delay_of(delay: str) -> Column:
    return F.expr(f"INTERVAL {delay}")


class LateRows:
    """Splits the batches of a stream at its watermark: the latest time of all batches before, less the delay.

    Rows at or behind the watermark go to a side table, part of the same batch;
    the others are handed on.  A stream's first batch has no watermark.  Rows
    without a time are never late.
    """

    def __init__(self, spark: SparkSession, path: str, delay: str = "10 minutes", ts: str = "ts"):
        self.path, self.delay, self.ts = path, delay, ts
        self.state = StateTable(spark, f"{path}/watermark", "part int, seen timestamp")

    def split(self, df: DataFrame, batch: int) -> DataFrame:
        """The rows in time; the late ones are written, and the watermark moves on."""
        mark = self.state.before(batch).select((F.max("seen") - delay_of(self.delay)).alias("_mark"))
        marked = df.crossJoin(F.broadcast(mark))  # one row
        late = F.coalesce(F.col(self.ts) <= F.col("_mark"), F.lit(False))
        marked.filter(late).drop("_mark").write.mode("overwrite").parquet(f"{self.path}/late/batch={batch}")
        self.state.merge(batch, df.agg(F.max(self.ts).alias("seen")).select(F.lit(0).alias("part"), "seen"), "part", {"seen": F.max})
        return marked.filter(~late).drop("_mark")

    def read(self, spark: SparkSession, schema) -> DataFrame:
        """All late rows so far, with the batch that brought them."""
        return spark.read.schema(schema).option("basePath", f"{self.path}/late").parquet(f"{self.path}/late")
