"""Export reading, sinks, and streams against their batch results."""

import datetime as dt
import json

from pyspark.sql import functions as F

from tertulia.operators import alarms as A, matches as M
from tertulia.plans.inputs import event_messages
from tertulia.sources import exports as S, sinks as K
from tertulia.streaming import alarms as SA


def export_dir(tmp_path):
    one = {"metadata": {"chat_name": "Ventas: uno", "total_messages": 2}, "messages": [
        {"id": 1, "sender_id": 7, "sender_name": "Ana", "text": "hola", "date": "2024-01-01T10:00:00+00:00", "reactions": {"👍": 2}, "media": None},
        {"sender_name": "sin id", "text": "x"},
        {"id": 2, "sender_id": None, "sender_name": "Luis", "text": "adios", "date": "2024-01-01T12:00:00Z", "reply_id": 1}]}
    (tmp_path / "a_2024-01-01_2024-02-01.json").write_text(json.dumps(one))
    (tmp_path / "b_2024-01-01_2024-02-01.json").write_text(json.dumps([{"id": 5, "user_id": 3, "text": "lista", "timestamp": "2024-01-02T00:00:00Z"}]))
    (tmp_path / "c.json").write_text("{not json")
    (tmp_path / "d.json").write_text(json.dumps({"other": 1}))
    return str(tmp_path)


def test_exports(spark, tmp_path):
    d = export_dir(tmp_path)
    docs = {r.chat_id: r for r in S.read_exports(spark, d).collect()}
    assert set(docs) == {0, 1, 3}  # the unreadable file keeps its rank
    assert docs[0].chat_name == "Ventas: uno" and docs[1].chat_name.startswith("b_2024") and docs[3].messages == []
    m = {r.id: r for r in S.read_messages(spark, d).collect()}
    assert set(m) == {1, 2, 5}
    assert m[2].user_key == "Luis" and m[5].user_key == "3" and m[1].reactions == {"👍": 2}
    assert m[5].ts is not None and m[2].reply_id == 1
    names = {r.chat_id: r.chats_analyzed for r in S.chat_display_names(S.read_messages(spark, d)).collect()}
    assert names[0] == ["a"] and names[1] == ["b"]


def test_missing_directory_is_skipped(spark, tmp_path):
    d = export_dir(tmp_path)
    assert S.read_exports(spark, [d + "/a_*.json", d + "/b_*.json"]).count() == 2


def test_labels(spark):
    df = spark.createDataFrame([("1",), ("1.9",), ("2",), ("Positivo",), ("no",), (None,)], "v string")
    assert [r[0] for r in df.select(S.truthy_label(F.col("v"))).collect()] == [1, 1, 0, 1, 0, 0]
    assert [r[0] for r in df.select(S.threshold_label(1.5)(F.col("v"))).collect()] == [0, 1, 1, 0, 0, 0]


def test_labelled_csv(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_text('review_text,review_rate\n"muy, bueno",8\nmalo,3\n')
    got = S.read_labelled(spark, str(p), "review_text", "review_rate", S.threshold_label(6)).collect()
    assert [(r.text, r.label) for r in got] == [("muy, bueno", 1), ("malo", 0)]


def test_indented_exports_of_any_size(spark, tmp_path):
    """Documents with line ends inside, one of several MB, and two chats whose cleaned names are the same."""
    big = {"metadata": {"chat_name": "a/b"}, "messages": [{"id": i, "text": f"line {i}\n" * 4, "date": "2024-01-01T00:00:00+00:00"} for i in range(60000)]}
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "big.json").write_text(json.dumps(big, indent=2))
    (tmp_path / "in" / "odd.json").write_text(json.dumps({"metadata": {"chat_name": "a:b"}, "messages": [{"id": 1, "text": "x", "date": "2024-01-01T00:00:00+00:00"}]}, indent=2))
    (tmp_path / "in" / "cut.json").write_text(json.dumps(big, indent=2)[:1000])
    m = S.read_messages(spark, str(tmp_path / "in"))
    assert m.groupBy("export_name").count().orderBy("count").collect() == [("a:b", 1), ("a/b", 60000)]
    named = m.withColumn("chat_name", F.col("export_name")).select("chat_id", "chat_name", "id", "text", "ts")
    K.write_documents(named, str(tmp_path / "out"))
    back = S.read_messages(spark, str(tmp_path / "out" / "*" / "*.txt"))
    assert back.count() == 60001 and back.select("chat_id").distinct().count() == 2
    K.write_export(named, str(tmp_path / "lines"))
    assert S.read_message_lines(spark, str(tmp_path / "lines")).groupBy("chat_id").count().count() == 2


def test_sinks_round_trip(spark, tmp_path):
    m = S.read_messages(spark, export_dir(tmp_path)).withColumn("chat_name", F.col("export_name")).select("chat_id", "chat_name", "id", "text", "ts")
    K.write_messages(m, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 3
    K.write_documents(m, str(tmp_path / "docs"))
    back = S.read_messages(spark, str(tmp_path / "docs" / "*" / "*.txt"))
    assert {(r.export_name, r.id, r.text) for r in back.collect()} == {(r.chat_name, r.id, r.text) for r in m.collect()}
    K.write_export(m, str(tmp_path / "lines"))
    lines = S.read_message_lines(spark, str(tmp_path / "lines"))
    assert {(r.chat_id, r.export_name, r.id, r.text) for r in lines.collect()} == {(r.chat_id, r.chat_name, r.id, r.text) for r in m.collect()}
    done = K.append_predictions(m, str(tmp_path / "pred"), ["id"], lambda d: d.select("id"), None)
    again = K.append_predictions(m, str(tmp_path / "pred"), ["id"], lambda d: d.select("id"), done)
    assert again.count() == 3
    K.write_csv(m.select("id", "text"), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 3


def write_stream_input(spark, sf_dir, tmp_path):
    m = event_messages(spark, sf_dir).select("chat_id", "id", "ts", "text", "user_key")
    # two files that share rows, the way touching ranges do
    m.filter("id < 600").coalesce(1).write.parquet(str(tmp_path / "in" / "p1"))
    m.filter("id >= 500").coalesce(1).write.parquet(str(tmp_path / "in" / "p2"))
    return m, SA.read_message_stream(spark, str(tmp_path / "in" / "*"), m.schema)


def test_pattern_stream_equals_batch(spark, sf_dir, tmp_path):
    m, stream = write_stream_input(spark, sf_dir, tmp_path)
    q = SA.write_hits(SA.pattern_stream(stream, keys=["hashtags", "emails"], delay="60 days"), str(tmp_path / "hits"), str(tmp_path / "cp"))
    q.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "hits")).select("id", "key", "ord", "value")
    want = M.extract_matches(m, ["hashtags", "emails"]).select("id", "key", "ord", "value")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    assert SA.late_rows(q) == 0


def test_alarm_stream_keeps_state(spark, sf_dir, tmp_path):
    from tertulia.plans.alarms import alarms

    m, stream = write_stream_input(spark, sf_dir, tmp_path)
    a = alarms(spark, sf_dir)
    SA.run_alarms(stream, a, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    hits = spark.read.parquet(str(tmp_path / "out" / "hits")).select("alarm_id", "id", "value")
    want = A.extract(m, a.filter("enabled"), None).select("alarm_id", "id", "value")
    assert hits.exceptAll(want).count() == 0 and want.exceptAll(hits).count() == 0
    state = {r.alarm_id: r.last_analyzed_message_id for r in SA.alarm_state(spark, str(tmp_path / "out")).collect()}
    top = {r.alarm_id: r.top for r in A.in_range(m, a.filter("enabled")).groupBy("alarm_id").agg(F.max("id").alias("top")).collect()}
    assert state == top


def test_unread_and_window_streams(spark, sf_dir, tmp_path):
    from tertulia.plans.alarms import alarms

    m, stream = write_stream_input(spark, sf_dir, tmp_path)
    q = SA.unread_stream(SA.deduplicated(stream, "60 days"), alarms(spark, sf_dir)).writeStream.outputMode("complete").format("memory").queryName("unread").option(
        "checkpointLocation", str(tmp_path / "cp1")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r.chat_id: r.unread for r in spark.table("unread").collect()} == {r.chat_id: r.n for r in m.groupBy("chat_id").agg(F.count("*").alias("n")).collect()}
    once = SA.read_message_stream(spark, str(tmp_path / "in" / "p1"), m.schema)
    q = SA.hourly_windows(once).writeStream.outputMode("complete").format("memory").queryName("hours").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    q.awaitTermination()
    want = SA.hourly_windows(m.filter("id < 600"), delay="")
    got = spark.table("hours")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_next_run_and_time_left(spark):
    base = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    df = spark.createDataFrame([(base, base + dt.timedelta(minutes=125))], "b timestamp, n timestamp")
    r = df.select(A.next_run(F.col("b"), F.lit(60), F.col("n")).alias("r"), A.time_left(F.col("n"), F.col("b")).alias("l"), A.time_left(F.col("b"), F.col("n")).alias("past"),
                  F.unix_micros(A.next_run(F.col("b"), F.lit(0), F.col("n"))).alias("none")).first()
    assert r.l == "2h 5m" and r.past == "Ahora" and r.none is None
    assert r.r.replace(tzinfo=dt.timezone.utc).hour in range(24)


def test_alarm_state_does_not_grow_with_batches(spark, sf_dir, tmp_path):
    """Many batches, a restart in between: one row per alarm, two versions at most, the same sums as at once."""
    import os

    from tertulia.plans.alarms import alarms

    m, a = event_messages(spark, sf_dir).select("chat_id", "id", "ts", "text"), alarms(spark, sf_dir)
    out, cp = str(tmp_path / "out"), str(tmp_path / "cp")
    sizes = []
    for k in range(6):
        m.filter(F.col("id") % 6 == k).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{k}"))
        stream = SA.read_message_stream(spark, str(tmp_path / "in" / "*"), m.schema, files_per_batch=1)
        SA.run_alarms(stream, a, out, cp, delay="90 days").awaitTermination()  # each run takes up where the last one stopped
        versions = [v for v in os.listdir(tmp_path / "out" / "state") if v.startswith("version=")]
        assert len(versions) <= 2
        sizes.append(SA.alarm_state(spark, out).count())
    seen = A.in_range(m, a.filter("enabled")).groupBy("alarm_id").agg(F.max("id").alias("top"), F.count("*").alias("n"))
    want = {r.alarm_id: (r.top, r.n) for r in seen.collect()}
    assert {r.alarm_id: (r.last_analyzed_message_id, r.messages) for r in SA.alarm_state(spark, out).collect()} == want
    assert sizes[-1] == len(want) and all(1 <= r.total_runs <= 6 for r in SA.alarm_state(spark, out).collect())


def test_state_of_a_repeated_batch(spark, tmp_path):
    from tertulia.streaming.state import StateTable

    t = StateTable(spark, str(tmp_path / "s"), "k int, n long")
    news = lambda *rows: spark.createDataFrame(list(rows), "k int, n long")
    how = {"n": F.sum}
    assert t.latest().count() == 0
    t.merge(0, news((1, 1)), "k", how)
    t.merge(1, news((1, 2), (2, 5)), "k", how)
    t.merge(1, news((1, 2), (2, 5)), "k", how)  # run again after a failure
    assert sorted(tuple(r) for r in t.latest().collect()) == [(1, 3), (2, 5)]
    t.merge(2, news((2, 1)), "k", how)
    assert t.versions() == [1, 2] and sorted(tuple(r) for r in t.latest().collect()) == [(1, 3), (2, 6)]


def test_late_rows_go_to_their_own_table(spark, tmp_path):
    at = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    parts = [[(1, at(5)), (2, at(10)), (3, None)], [(4, at(7)), (5, at(8)), (6, at(20)), (7, None)], [(8, at(9)), (9, at(18)), (10, at(19)), (11, at(17))], []]
    schema = "id long, ts timestamp"
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{k}"))
    stream = SA.read_message_stream(spark, str(tmp_path / "in" / "*"), schema, files_per_batch=1)
    out = str(tmp_path / "out")
    SA.write_in_time(stream, out, str(tmp_path / "cp"), "2 hours").awaitTermination()
    late = {r.id: r.batch for r in SA.late_table(spark, out, schema).collect()}
    assert late == {4: 1, 5: 1, 8: 2, 9: 2, 11: 2}
    kept = spark.read.option("basePath", out + "/table").parquet(out + "/table")
    assert sorted(r.id for r in kept.collect()) == [1, 2, 3, 6, 7, 10]


def test_first_folder_that_has_an_export(spark, tmp_path):
    for folder, name, n in (("a", "x.json", 1), ("b", "x.json", 2), ("b", "y.json", 3)):
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / name).write_text(json.dumps([{"id": k, "text": "t", "date": "2024-01-01T00:00:00+00:00"} for k in range(n)]))
    folders = (str(tmp_path / "a"), str(tmp_path / "b"))
    got = S.read_named(spark, ["x.json", "y.json", "z.json"], folders)
    assert {r.export_name: r.n for r in got.groupBy("export_name").agg(F.count("*").alias("n")).collect()} == {"x": 1, "y": 3}
    assert S.read_named(spark, ["z.json"], folders).count() == 0
    assert S.first_existing(spark, [str(tmp_path / "b" / "y.json")]) == [str(tmp_path / "b" / "y.json")]


def test_saved_runs(spark, tmp_path):
    base = str(tmp_path / "results")
    one = spark.createDataFrame([(1, "a"), (2, "b")], "id long, word string")
    K.save_run({"words": one, "empty": one.limit(0)}, base, 1)
    K.save_run({"words": one.withColumn("score", F.lit(0.5))}, base, 2)
    (tmp_path / "results" / "tables" / "words" / "run=3").mkdir()  # a run that broke off
    got = K.load_saved(spark, base)
    assert set(got) == {"words", "empty"} and got["empty"].count() == 0
    assert sorted((r.run, r.id, r.score) for r in got["words"].collect()) == [(1, 1, None), (1, 2, None), (2, 1, 0.5), (2, 2, 0.5)]
    assert K.load_saved(spark, base, latest=True)["words"].select("run").distinct().collect() == [(2,)]
    K.save_run({"words": one.limit(1)}, base, 2)  # saved again
    assert K.load_saved(spark, base)["words"].filter("run = 2").count() == 1
    lines = {(r.name, r.run): (r.rows, r.columns) for r in K.manifest(spark, base).collect()}
    assert lines == {("words", 1): (2, ["id", "word"]), ("empty", 1): (0, ["id", "word"]), ("words", 2): (1, ["id", "word"])}
