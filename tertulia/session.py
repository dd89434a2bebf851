"""Session settings and durable intermediate tables."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


def build_session(app: str = "tertulia", master: str | None = None, **conf) -> SparkSession:
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.ui.enabled": "false",
        **conf,
    }
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``.  Only a local master may
    fall back to a temporary folder, since executors elsewhere could not see it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a shared folder")
    made = tempfile.mkdtemp(prefix="tertulia-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def new_table_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder nobody else writes to."""
    return os.path.join(shared_dir(spark), spark.sparkContext.applicationId, f"{label}-{uuid.uuid4().hex}")


class KeyedTable:
    """A table that gains rows round by round and lies bucketed by its key.

    A join on the key reads the buckets as they are: only the other side is
    shuffled, whatever the table has grown to.  There are as many buckets as
    shuffle partitions, so the other side goes to as many tasks as usual.
    """

    def __init__(self, spark: SparkSession, label: str, key: list[str]):
        self.spark, self.key = spark, key
        self.name = f"{label}_{uuid.uuid4().hex}"
        self.path = new_table_path(spark, label)
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def append(self, df: DataFrame) -> None:
        """Adds rows; those of a bucket come from one task, so that a round writes a file per bucket."""
        dealt = df.repartition(self.buckets, *self.key)
        dealt.write.mode("append").format("parquet").option("path", self.path).bucketBy(self.buckets, *self.key).saveAsTable(self.name)

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def forget(self) -> DataFrame:
        """The rows as a plain table; the bucketed name leaves the session's catalog, the files stay."""
        schema = self.read().schema
        self.spark.sql(f"DROP TABLE {self.name}")
        return self.spark.read.schema(schema).parquet(self.path)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage of iterative jobs and gives the next stage real table
    sizes, so join strategies are chosen from what was written.  Survives the
    loss of any executor.
    """
    spark = df.sparkSession
    path = new_table_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


ROWS_PER_TASK = 200_000


def spread(df: DataFrame, rows: int | None = None) -> DataFrame:
    """A scan dealt anew where few of its tasks would hold most rows, for work that is heavy per row.

    A file is split by its size, but a split that no row group begins in is
    empty, so the rows of every split are counted (from the files' footers).
    There are then as many parts as cores at least, of about `rows` rows
    (ROWS_PER_TASK unless given).  A scan that lies so already stays as it is.
    """
    held = df.select(F.spark_partition_id().alias("p")).groupBy("p").agg(F.count("*").alias("n"))
    most, n = held.agg(F.max("n"), F.sum("n")).first()
    parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-(n or 0) // (rows or ROWS_PER_TASK)))
    return df.repartition(parts) if (most or 0) > 2 * -(-(n or 0) // parts) else df
