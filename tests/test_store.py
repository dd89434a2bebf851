"""The message store: what it holds, what it opens, and alarms over it."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tertulia.operators import alarms as A
from tertulia.plans.alarms import alarms, now
from tertulia.plans.inputs import event_messages
from tertulia.sources.store import MessageStore, bucket_of


@pytest.fixture(scope="module")
def messages(spark, sf_dir):
    return event_messages(spark, sf_dir).select("chat_id", "id", "ts", "text")


@pytest.fixture(scope="module")
def store(messages, tmp_path_factory):
    return MessageStore.create(messages, str(tmp_path_factory.mktemp("store") / "s"), buckets=4)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_holds_everything(store, messages):
    assert store.read().columns == messages.columns
    assert rows(store.read()) == rows(messages)
    again = MessageStore(store.sparkSession, store.path)
    assert again.buckets == 4 and again.columns == messages.columns


def test_ranges_open_only_their_folders(store, messages):
    days = store.between_days("2024-01-05", "2024-01-09")
    assert "PartitionFilters: [isnotnull(day" in plan(days)
    assert rows(days) == rows(messages.filter(F.to_date("ts").between("2024-01-05", "2024-01-09")))
    files = lambda df: len(df.inputFiles())
    assert 0 < len(days.select(F.input_file_name().alias("f")).distinct().collect()) <= 5 * 4 < files(store.read())
    times = store.between_times("2024-01-06 09:00:00", "2024-01-05 10:00:00")
    assert "PartitionFilters: [isnotnull(day" in plan(times) and "PushedFilters: [IsNotNull(ts)" in plan(times)
    assert rows(times) == rows(messages.filter(F.col("ts").between("2024-01-05 10:00:00", "2024-01-06 09:00:00")))
    chats = store.of_chats(2, 7)
    assert "bucket" in plan(chats).split("PartitionFilters: [")[1].split("]")[0]
    assert rows(chats) == rows(messages.filter(F.col("chat_id").isin(2, 7)))


def test_alarm_ranges_prune_while_the_query_runs(spark, sf_dir, store, messages):
    a = alarms(spark, sf_dir)
    got = A.in_range(store, a)
    text = plan(got)
    assert "dynamicpruning" in text.lower() and "PartitionFilters" in text
    want = A.in_range(messages, a)
    cols = ["alarm_id", "id"]
    assert rows(got.select(*cols)) == rows(want.select(*cols)) and got.columns.sort() == want.columns.sort()
    hits = lambda m: rows(A.extract(m, a, None).select("alarm_id", "pattern_no", "id", "ord", "value"))
    assert hits(store) == hits(messages) != []
    state = lambda m: rows(A.advance(a, m, now()).select("alarm_id", F.coalesce("last_analyzed_message_id", F.lit(-1)), "updated"))
    assert state(store) == state(messages)
    assert rows(A.no_updates(a, store)) == rows(A.no_updates(a, messages))


def test_a_pattern_is_matched_once_per_message(spark, messages):
    """Many alarms with the same pattern on one chat: messages are not copied."""
    a = spark.createDataFrame(
        [(k, 3, dt.datetime(2020, 1, 1), dt.datetime(2030, 1, 1), [("p", r"\d+ usd", "custom"), ("q", "", "custom"), ("r", "(", "custom")]) for k in range(6)],
        "alarm_id int, chat_id long, date_from timestamp, date_to timestamp, patterns array<struct<name:string,pattern:string,type:string>>")
    chat = messages.filter("chat_id = 3")
    assert A._watched(messages, a).count() == chat.count()
    one = rows(A.extract(messages, a.filter("alarm_id = 0"), None).select("id", "ord", "value"))
    assert one and rows(A.extract(messages, a, None).select("id", "ord", "value")) == sorted(one * 6)


def test_append_keeps_one_copy(spark, messages, tmp_path):
    odd = spark.createDataFrame([(None, 1, None, "no chat, no time"), (1, 2, None, "no time"), (1, 1, dt.datetime(2024, 1, 1), "a")], "chat_id long, id long, ts timestamp, text string")
    store = MessageStore.create(odd, str(tmp_path / "s"), buckets=3)
    store.append(odd)
    more = spark.createDataFrame([(1, 1, dt.datetime(2024, 1, 1), "a"), (1, 3, dt.datetime(2024, 1, 2), "b"), (1, 3, dt.datetime(2024, 1, 2), "b"), (1, 2, None, "no time")],
                                 "chat_id long, id long, ts timestamp, text string")
    store.append(more)
    got = store.read().select("chat_id", "id")
    assert sorted(((r.chat_id or 0, r.id) for r in got.collect())) == [(0, 1), (1, 1), (1, 2), (1, 3)]
    store.append(more.limit(0))
    assert store.between_days("2024-01-01", "2024-01-01").count() == 1
    with pytest.raises(ValueError, match="day"):
        MessageStore.create(odd.withColumn("Day", F.lit(1)), str(tmp_path / "x"))


def test_hot_chat_is_spread_over_files(spark, tmp_path):
    """One day of one chat is several files when it is larger than a file should be."""
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        m = spark.range(60_000).select(F.lit(1).cast("long").alias("chat_id"), "id", F.lit(dt.datetime(2024, 1, 1)).alias("ts"), F.sha2(F.col("id").cast("string"), 256).alias("text"))
        store = MessageStore.create(m.repartition(6), str(tmp_path / "s"))
        assert len(store.read().inputFiles()) > 3 and store.read().count() == 60_000
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")


def test_empty_ranges(spark, sf_dir, store):
    none = alarms(spark, sf_dir).limit(0)
    assert A.in_range(store, none).count() == 0 and A.extract(store, none).count() == 0
    backwards = alarms(spark, sf_dir).withColumns({"date_from": F.col("date_to"), "date_to": F.col("date_from")})
    assert A.in_range(store, backwards).count() == 0


def test_buckets_are_stable(spark):
    got = spark.range(3).select(bucket_of("id", 16).alias("b")).collect()
    assert all(0 <= r.b < 16 for r in got)


def test_a_scan_whose_rows_lie_in_one_split_is_dealt_anew(spark, tmp_path):
    """A file of one row group has many splits but rows in one of them only."""
    from pyspark.sql import functions as F

    from tertulia.session import spread

    at = str(tmp_path / "one")
    spark.range(4000, numPartitions=1).select("id", F.sha2(F.col("id").cast("string"), 256).alias("text")).write.parquet(at)
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k in old:
            spark.conf.set(k, "2000")
        scan = spark.read.parquet(at)
        cores = spark.sparkContext.defaultParallelism
        held = lambda df: [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
        assert scan.rdd.getNumPartitions() > cores and held(scan) == [4000]
        assert max(held(spread(scan))) <= 2 * 4000 / cores and sum(held(spread(scan))) == 4000
        assert len(held(spread(scan, 100))) == 40
        assert spread(spark.read.parquet(at).limit(0)).count() == 0
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
