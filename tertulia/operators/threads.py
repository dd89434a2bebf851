"""Measures of reconstructed threads.

``members`` has chat_id, root_id, msg_id, level; ``nodes`` the message
attributes.  Only threads of two or more messages count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .ranking import lookback, top_k


def thread_rows(members: DataFrame, nodes: DataFrame, *columns: str) -> DataFrame:
    """Members of real threads with message attributes attached."""
    real = members.filter(F.col("level") == 1).select("chat_id", "root_id").distinct()
    attrs = nodes.select("chat_id", F.col("id").alias("msg_id"), *columns)
    return members.join(real, ["chat_id", "root_id"], "left_semi").join(attrs, ["chat_id", "msg_id"])


def totals(threads: DataFrame) -> DataFrame:
    return threads.agg(
        F.count("*").alias("total_threads"), F.coalesce(F.avg("size"), F.lit(0.0)).alias("avg_thread_length"),
        F.coalesce(F.max("size"), F.lit(0)).alias("max_thread_length"), F.coalesce(F.min("size"), F.lit(0)).alias("min_thread_length"))


def length_histogram(threads: DataFrame) -> DataFrame:
    return threads.groupBy("size").agg(F.count("*").alias("threads"))


def participation(rows: DataFrame, top: int | None = 10) -> DataFrame:
    """Threads per user.  Users of a thread are made distinct before counting."""
    per = rows.filter(F.col("user_key").isNotNull()).select("chat_id", "root_id", "user_key").distinct()
    out = per.groupBy("user_key").agg(F.count("*").alias("threads")).orderBy(F.col("threads").desc(), "user_key")
    return out.limit(top) if top else out


def starters(rows: DataFrame, top: int = 10) -> DataFrame:
    first = rows.filter((F.col("level") == 0) & F.col("user_key").isNotNull())
    return first.groupBy("user_key").agg(F.count("*").alias("threads")).orderBy(F.col("threads").desc(), "user_key").limit(top)


def intention_sequences(rows: DataFrame, top: int = 10, length: int = 3) -> DataFrame:
    """Most common opening sequences of intentions; only `length` rows per thread are gathered."""
    head = top_k(rows, ["chat_id", "root_id"], ["level", "ts", "msg_id"], length)
    seq = head.groupBy("chat_id", "root_id").agg(F.array_sort(F.collect_list(F.struct("level", "ts", "msg_id", "intention"))).alias("s"))
    text = F.array_join(F.transform("s", lambda x: x["intention"]), " → ")
    return seq.groupBy(text.alias("pattern")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "pattern").limit(top)


def response_gaps(rows: DataFrame) -> DataFrame:
    """Seconds between neighbours of a thread in (level, time, id) order."""
    base = rows.select("chat_id", "root_id", "msg_id", "level", "ts")
    prev = lookback(base, ["chat_id", "root_id"], ["level", "ts", "msg_id"], [], 1, F.floor(F.col("level") / 16))
    before = F.get("prev", F.lit(0))
    return prev.filter(F.size("prev") > 0).select(
        "chat_id", "root_id", "msg_id", before["msg_id"].alias("prev_id"),
        ((F.unix_micros("ts") - F.unix_micros(before["ts"])) / 1000000.0).alias("gap_seconds"))


def spans(threads: DataFrame) -> DataFrame:
    return threads.select("chat_id", "root_id", "start_ts", "end_ts",
                          (F.unix_seconds("end_ts") - F.unix_seconds("start_ts")).alias("duration_seconds"))


def time_of_day(ts: Column | str) -> Column:
    h = F.hour(ts)
    return (F.when(h.between(6, 11), "morning").when(h.between(12, 17), "afternoon").when(h >= 18, "evening").otherwise("night"))


def time_of_day_counts(threads: DataFrame) -> DataFrame:
    return threads.filter(F.col("start_ts").isNotNull()).groupBy(time_of_day("start_ts").alias("slot")).agg(F.count("*").alias("threads"))


def content(rows: DataFrame) -> DataFrame:
    return rows.agg(F.coalesce(F.avg(F.length("text")), F.lit(0.0)).alias("avg_message_length"), F.count("*").alias("total_messages_analyzed"))


def intention_distribution(rows: DataFrame) -> DataFrame:
    g = rows.groupBy("intention").agg(F.count("*").alias("n"))
    return g.withColumn("percent", F.round(F.col("n") * 100.0 / F.sum("n").over(W.partitionBy()), 1))  # at most 7 rows


def chat_cards(messages: DataFrame, threads: DataFrame, rows: DataFrame, edges: DataFrame) -> DataFrame:
    """One result row per chat."""
    m = messages.groupBy("chat_id").agg(F.count("*").alias("messages"))
    u = messages.filter(F.col("user_key").isNotNull()).select("chat_id", "user_key").distinct().groupBy("chat_id").agg(F.count("*").alias("users"))
    t = threads.groupBy("chat_id").agg(F.count("*").alias("threads"), F.avg("size").alias("avg_thread_length"))
    a = rows.select("chat_id", "user_key").distinct().groupBy("chat_id").agg(F.count("user_key").alias("active_users"))
    s = top_k(rows, ["chat_id", "root_id"], ["level", "ts", "msg_id"], 3).groupBy("chat_id", "root_id").agg(
        F.array_sort(F.collect_list(F.struct("level", "ts", "msg_id", "intention"))).alias("s")
    ).select("chat_id", F.array_join(F.transform("s", lambda x: x["intention"]), " → ").alias("p")).distinct().groupBy("chat_id").agg(
        F.count("*").alias("patterns"))
    e = edges.groupBy("chat_id").agg(F.count("*").alias("reply_edges"))
    out = m
    for part in (u, t, a, s, e):
        out = out.join(part, "chat_id", "left")
    return out.fillna(0)


def corpus_totals(cards: DataFrame, messages: DataFrame) -> DataFrame:
    sums = cards.agg(F.count("*").alias("chats"), F.sum("threads").alias("threads"), F.sum("messages").alias("messages"),
                     F.sum("users").alias("users_by_chat"), F.sum("reply_edges").alias("reply_edges"))
    users = messages.select("user_key").distinct().agg(F.count("user_key").alias("distinct_users"))
    return sums.join(F.broadcast(users))  # one row each


def primary_user(rows: DataFrame) -> DataFrame:
    per = rows.filter(F.col("user_key").isNotNull()).groupBy("chat_id", "root_id", "user_key").agg(F.count("*").alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("neg"), "user_key"))
    return per.groupBy("chat_id", "root_id").agg(best.alias("b")).select("chat_id", "root_id", F.col("b.user_key").alias("primary_user"), (-F.col("b.neg")).alias("n"))


def chronological(rows: DataFrame) -> DataFrame:
    """Rows of threads in reading order: unknown times first; blank and one-letter texts left out."""
    return rows.filter(F.length(F.trim("text")) > 1).orderBy("chat_id", "root_id", F.col("ts").asc_nulls_first(), "msg_id")


def search_chats(chats: DataFrame, needle: str) -> DataFrame:
    return chats.filter(F.contains(F.lower("chat_name"), F.lit(needle.lower().strip())))


def bars(ranked: DataFrame, value: str, top: int = 5) -> DataFrame:
    """First rows by value with their ratio to the largest."""
    key = [c for c in ranked.columns if c != value][0]
    head = ranked.orderBy(F.col(value).desc(), key).limit(top)
    return head.withColumn("bar", F.col(value) / F.max(value).over(W.partitionBy()))
