"""Structured Streaming forms of the alarms and of the activity measures."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import alarms as A
from ..operators.matches import extract_matches
from .state import LateRows, StateTable


def read_message_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet", files_per_batch: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema).format(fmt)
    if files_per_batch:
        r = r.option("maxFilesPerTrigger", files_per_batch)
    return r.load(path)


def deduplicated(messages: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """One copy of each message although ranges touch; state is dropped behind the watermark."""
    return messages.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["chat_id", "id"])


def pattern_stream(messages: DataFrame, alarms: DataFrame | None = None, keys=None, delay: str = "10 minutes") -> DataFrame:
    """Hits of a message stream: the built-in rules, or the patterns of the alarms watching each chat."""
    m = deduplicated(messages, delay)
    if alarms is None:
        return extract_matches(m, keys)
    return A.extract(m, alarms.filter("enabled"), per_pattern=None)


def write_hits(hits: DataFrame, path: str, checkpoint: str, once: bool = True, interval: str | None = None):
    """Append hits to a table.  The file sink and the checkpoint make every batch exactly-once."""
    w = hits.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime=interval or "1 minute")).start()


ALARM_STATE = "alarm_id long, last_analyzed_message_id long, total_runs long, messages long"


def run_alarms(messages: DataFrame, alarms: DataFrame, out: str, checkpoint: str, once: bool = True, interval: str | None = None, delay: str = "10 minutes"):
    """Alarm run per batch: hits, and the state of every alarm that ever saw a message.

    Hits are keyed by batch and overwritten on a retry; the state is one row
    per alarm, whatever the number of batches.  Ids of messages seen are kept
    until the watermark has passed them, and messages behind it count no more.
    """
    m, spark = deduplicated(messages, delay), messages.sparkSession
    state = _alarm_table(spark, out)

    def batch(df: DataFrame, batch_id: int):
        a, stored = alarms.filter("enabled"), os.path.join(out, "batch")
        df.write.mode("overwrite").parquet(stored)  # read twice below, and worked out once
        df = spark.read.schema(df.schema).parquet(stored)
        A.extract(df, a, per_pattern=None).write.mode("overwrite").parquet(os.path.join(out, "hits", f"batch={batch_id}"))
        seen = A.in_range(df, a).groupBy(F.col("alarm_id").cast("long").alias("alarm_id")).agg(
            F.max("id").alias("last_analyzed_message_id"), F.lit(1).cast("long").alias("total_runs"), F.count("*").alias("messages"))
        state.merge(batch_id, seen, "alarm_id", {"last_analyzed_message_id": F.max, "total_runs": F.sum, "messages": F.sum})

    w = m.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime=interval or "1 minute")).start()


def _alarm_table(spark: SparkSession, out: str) -> StateTable:
    return StateTable(spark, os.path.join(out, "state"), ALARM_STATE)


def alarm_state(spark: SparkSession, out: str) -> DataFrame:
    """The newest state of each alarm."""
    return _alarm_table(spark, out).latest()


def write_in_time(messages: DataFrame, out: str, checkpoint: str, delay: str = "10 minutes", ts: str = "ts", once: bool = True, interval: str | None = None):
    """Messages in time to ``out``/table, messages behind the watermark to a side table of the same run (`late_table`)."""
    late = LateRows(messages.sparkSession, out, delay, ts)

    def batch(df: DataFrame, batch_id: int):
        late.split(df, batch_id).write.mode("overwrite").parquet(os.path.join(out, "table", f"batch={batch_id}"))

    w = messages.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime=interval or "1 minute")).start()


def late_table(spark: SparkSession, out: str, schema) -> DataFrame:
    return LateRows(spark, out).read(spark, schema)


def unread_stream(messages: DataFrame, alarms: DataFrame) -> DataFrame:
    """Running unread counter per chat with the alarm flag (update mode)."""
    watched = alarms.filter("enabled").select("chat_id").distinct().withColumn("alarm_hit", F.lit(True))
    flagged = messages.join(watched, "chat_id", "left").withColumn("alarm_hit", F.coalesce("alarm_hit", F.lit(False)))
    return flagged.groupBy("chat_id").agg(F.count("*").alias("unread"), F.max("alarm_hit").alias("alarm_hit"))


def write_whole(counts: DataFrame, path: str, checkpoint: str, once: bool = True, interval: str | None = None):
    """The whole result of a grouped stream, written anew by every batch: for small tables such as counts per chat or window."""
    w = counts.writeStream.outputMode("complete").foreachBatch(lambda df, batch: df.write.mode("overwrite").parquet(path)).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime=interval or "1 minute")).start()


def hourly_windows(messages: DataFrame, delay: str = "10 minutes", length: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Messages per chat in tumbling (or sliding) windows of event time."""
    m = messages.withWatermark("ts", delay) if delay else messages
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    return m.groupBy(w.alias("w"), "chat_id").agg(F.count("*").alias("n")).select(
        F.col("w.start").alias("start"), F.col("w.end").alias("end"), "chat_id", "n")


def bursts(messages: DataFrame, gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """Conversation bursts: sessions closed by a silence of `gap`."""
    m = messages.withWatermark("ts", delay) if delay else messages
    return m.groupBy(F.session_window("ts", gap).alias("w"), "chat_id").agg(F.count("*").alias("n")).select(
        F.col("w.start").alias("start"), F.col("w.end").alias("end"), "chat_id", "n")


def late_rows(query) -> int:
    """Messages that arrived behind the watermark, from the query's progress reports."""
    return sum(op.get("numRowsDroppedByWatermark", 0) for p in query.recentProgress for op in p["stateOperators"])
