"""Stored messages: a table cut by day and by bucket of chats, read with pruning.

Rows lie in one folder per day and bucket (a hash of the chat), sorted by chat
and time.  A range of days and a set of chats then name folders, so a scan opens
only these; inside, a file's own statistics skip chats and times.  Ranges that
come from a table (alarms) prune while the query runs: the days and buckets
they ask for are joined on the folders' columns.

A day of a bucket that a chat with many messages fills is split over files of
the usual size when it is written.  Rows without a time or chat are kept in
folders of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

BUCKETS = 16
DAY, BUCKET = "day", "bucket"


def bucket_of(chat: Column | str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(chat), F.lit(buckets)).cast("int")


class MessageStore:
    """A stored table of messages with columns chat_id and ts; ``read`` gives it as a DataFrame."""

    def __init__(self, spark: SparkSession, path: str):
        self.sparkSession, self.path = spark, path
        layout = spark.read.json(f"{path}/layout").first()
        self.buckets, self.columns = layout["buckets"], list(layout["columns"])

    @classmethod
    def create(cls, messages: DataFrame, path: str, buckets: int = BUCKETS) -> MessageStore:
        """A new store that holds ``messages``; columns named as the folders' columns are an error."""
        taken = {DAY, BUCKET} & {c.lower() for c in messages.columns}
        if taken:
            raise ValueError(f"columns {sorted(taken)} are the store's own")
        spark = messages.sparkSession
        spark.createDataFrame([(buckets, messages.columns)], "buckets int, columns array<string>").coalesce(1).write.json(f"{path}/layout")
        store = cls(spark, path)
        store._write(messages, "errorifexists")
        return store

    def _write(self, messages: DataFrame, mode: str) -> None:
        rows = messages.select(*self.columns).withColumns({DAY: F.to_date("ts"), BUCKET: bucket_of("chat_id", self.buckets)})
        rows.hint("rebalance", DAY, BUCKET).sortWithinPartitions(DAY, BUCKET, "chat_id", "ts").write.mode(mode).partitionBy(DAY, BUCKET).parquet(f"{self.path}/messages")

    def append(self, messages: DataFrame, key: tuple[str, ...] = ("chat_id", "id")) -> None:
        """Adds the messages that are not stored yet; ranges fetched again may touch or overlap.

        Only the days the new messages span are looked through (two dates reach the driver).
        """
        span = messages.agg(F.min(F.to_date("ts")).alias("a"), F.max(F.to_date("ts")).alias("b")).first()
        known = self.read().filter(F.to_date("ts").isNull())
        if span["a"] is not None:
            known = known.unionByName(self.between_days(span["a"], span["b"]))
        new, known = messages.dropDuplicates(list(key)), known.select(*[F.col(c).alias("_" + c) for c in key]).distinct()
        same = [new[c].eqNullSafe(known["_" + c]) for c in key]
        self._write(new.join(known, same, "left_anti"), "append")

    def _folders(self) -> DataFrame:
        return self.sparkSession.read.parquet(f"{self.path}/messages")

    def read(self) -> DataFrame:
        return self._folders().select(*self.columns)

    def between_days(self, first, last) -> DataFrame:
        """Calendar days, both ends kept."""
        return self._folders().filter(F.col(DAY).between(F.to_date(F.lit(str(first))), F.to_date(F.lit(str(last))))).select(*self.columns)

    def between_times(self, a, b) -> DataFrame:
        """Instants, both ends kept; swapped bounds are put in order."""
        lo, hi = sorted([str(a), str(b)])
        lo, hi = F.to_timestamp(F.lit(lo)), F.to_timestamp(F.lit(hi))
        return self._folders().filter(F.col(DAY).between(F.to_date(lo), F.to_date(hi)) & F.col("ts").between(lo, hi)).select(*self.columns)

    def of_chats(self, *chats: int) -> DataFrame:
        """The messages of a few named chats."""
        buckets = [bucket_of(F.lit(c).cast("long"), self.buckets) for c in chats]
        return self._folders().filter(F.col(BUCKET).isin(buckets) & F.col("chat_id").isin(list(chats))).select(*self.columns)

    def in_ranges(self, ranges: DataFrame, first: str = "date_from", last: str = "date_to") -> DataFrame:
        """Messages joined with the ranges (chat_id and two instants, other columns kept) that hold them.

        The earliest and the latest instant of all ranges bound the days read
        (they reach the driver); the days and buckets of each range prune the
        folders while the query runs, where Spark finds the ranges small enough
        to broadcast.
        """
        asked = ranges.filter(F.col(first) <= F.col(last))
        ends = asked.agg(F.min(F.to_date(first)).alias("a"), F.max(F.to_date(last)).alias("b")).first()
        rows = self._folders()
        if ends["a"] is not None:
            rows = rows.filter(F.col(DAY).between(F.lit(ends["a"]), F.lit(ends["b"])))
        by_day = asked.withColumn(DAY, F.explode(F.sequence(F.to_date(first), F.to_date(last)))).withColumn(BUCKET, bucket_of("chat_id", self.buckets))
        met = rows.join(by_day, [DAY, BUCKET, "chat_id"]).filter(F.col("ts").between(F.col(first), F.col(last)))
        return met.select(*self.columns, *[c for c in ranges.columns if c != "chat_id"])
