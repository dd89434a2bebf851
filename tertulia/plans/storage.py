"""Queries that write tables out and read them back: exports, pair rows, CSV, graphs, models, alarm state."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import alarms as A, graph as G, pairs as P, sentiment as M, threads as H
from ..session import new_table_path
from ..sources import exports as S, sinks as K
from ..streaming import alarms as SA
from .alarms import ALARMS, IN_RANGE, _stream_messages, alarms
from .graph import FACTORS, MEMBERS, graph_parts, nodes, replies, thread_table
from .inputs import CONVERSATION_MESSAGES, EVENT_MESSAGES, conversation_messages, event_messages, table
from .pairs import PAIRS, _ORDER, pairs
from .registry import ORACLES, query
from .scoring import TOKENS, labelled_tokens


def fresh(spark, name: str) -> str:
    return new_table_path(spark, name)


def _to_export(spark, d):
    m = conversation_messages(spark, d)
    return m.select("chat_id", F.concat(F.lit("Chat: "), F.col("chat_id").cast("string")).alias("chat_name"), "id", "sender_name", "text", "reply_id", "ts",
                   F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ssXXX").alias("date"))


def exported(spark, d) -> str:
    """Conversation messages written as indented chat documents; returns the pattern of their files."""
    base = fresh(spark, "exports")
    K.write_documents(_to_export(spark, d), base)
    return f"{base}/*/*.txt"


@query("s01_export_scan", f"WITH {CONVERSATION_MESSAGES} SELECT 'Chat: ' || chat_id AS chat_name, id, sender_name, reply_id, epoch_us(ts) AS ts, text FROM messages")
def s01(spark, d):
    return S.read_messages(spark, exported(spark, d)).select(
        F.col("export_name").alias("chat_name"), "id", "sender_name", "reply_id", F.unix_micros("ts").alias("ts"), "text")


@query("s01b_message_lines", f"WITH {CONVERSATION_MESSAGES} SELECT 'Chat: ' || chat_id AS chat_name, id, sender_name, reply_id, epoch_us(ts) AS ts, text FROM messages")
def s01b(spark, d):
    base = fresh(spark, "export-lines")
    K.write_export(_to_export(spark, d), base)
    return S.read_message_lines(spark, base).select("chat_name", "id", "sender_name", "reply_id", F.unix_micros("ts").alias("ts"), "text")


@query("s02_fallback_folder", f"WITH {CONVERSATION_MESSAGES} SELECT 'Chat: ' || chat_id AS chat_name, count(*) AS messages FROM messages WHERE chat_id IN (2, 3, 7) GROUP BY 1")
def s02(spark, d):
    """Exports asked for by name: some lie in the first folder, some only in the second, one in neither."""
    base, m = fresh(spark, "exports"), _to_export(spark, d)
    K.write_documents(m.filter(F.col("chat_id") < 5), f"{base}/first")
    K.write_documents(m, f"{base}/chats")
    names = [r["chat_folder"] for r in K.export_documents(m.filter(F.col("chat_id").isin(2, 3, 7))).select("chat_folder").collect()]
    folders = (f"{base}/first", f"{base}/chats")
    paths = S.first_existing(spark, [f"chat_folder={n}" for n in [*names, "missing"]], folders)
    return S.read_messages(spark, paths).groupBy(F.col("export_name").alias("chat_name")).agg(F.count("*").alias("messages"))


@query("s03_export_directory", f"WITH {CONVERSATION_MESSAGES} SELECT chat_id, count(*) AS messages FROM messages GROUP BY 1")
def s03(spark, d):
    # folders sort by chat number here, so the file rank is the chat number
    docs = S.read_exports(spark, exported(spark, d))
    return docs.select("chat_id", F.size("messages").cast("long").alias("messages"))


@query("s04_export_metadata", f"WITH {CONVERSATION_MESSAGES} SELECT 'Chat: ' || chat_id AS chat_name, count(*) AS total_messages, CAST(CAST(min(ts) AS DATE) AS VARCHAR) AS start_date, CAST(CAST(max(ts) AS DATE) AS VARCHAR) AS end_date FROM messages GROUP BY chat_id")
def s04(spark, d):
    return S.read_exports(spark, exported(spark, d)).select("chat_name", "metadata.total_messages", "metadata.start_date", "metadata.end_date")


@query("s05_display_names", "SELECT CAST(r_regionkey AS BIGINT) AS chat_id, CASE WHEN r_regionkey % 2 = 0 THEN r_name ELSE 'grupo ' || lower(r_name) END AS names FROM region")
def s05(spark, d):
    r = table(spark, d, "region")
    m = r.select(F.col("r_regionkey").cast("long").alias("chat_id"), F.when(F.col("r_regionkey") % 2 == 0, F.col("r_name")).otherwise("unknown").alias("chat_name"),
                 F.concat(F.lit("/x/grupo_"), F.lower("r_name"), F.lit("_2024-01-01_2024-02-01.json")).alias("file"))
    return S.chat_display_names(m).select("chat_id", F.array_join("chats_analyzed", ",").alias("names"))


@query("k01_message_lines", f"WITH {EVENT_MESSAGES} SELECT chat_id, id, text FROM messages")
def k01(spark, d):
    base = fresh(spark, "lines")
    m = event_messages(spark, d).select("chat_id", "id", "text", F.concat(F.lit("c/"), F.col("chat_id").cast("string")).alias("chat_name"))
    K.write_messages(m, base)
    return spark.read.schema("chat_id long, id long, text string").json(base).select("chat_id", "id", "text")


@query("k02_stored_patterns", f"WITH {EVENT_MESSAGES} SELECT id, unnest(regexp_extract_all(text, '#[A-Za-z0-9_]+')) AS value FROM messages")
def k02(spark, d):
    from ..operators.matches import extract_matches

    base = fresh(spark, "patterns")
    K.write_results({"matches": extract_matches(event_messages(spark, d), ["hashtags"])}, base)
    return spark.read.parquet(f"{base}/matches").select("id", "value")


@query("k03_stored_graph", FACTORS + "SELECT relationship AS kind, count(*) AS n FROM alledges GROUP BY 1 UNION ALL SELECT 'user', count(*) FROM users")
def k03(spark, d):
    users, _, edges = graph_parts(spark, d)
    base = fresh(spark, "graph")
    K.write_graph(users, edges, base)
    return spark.read.parquet(f"{base}/edges").groupBy(F.col("relationship").alias("kind")).agg(F.count("*").alias("n")).unionByName(
        spark.read.parquet(f"{base}/nodes").agg(F.count("*").alias("n")).select(F.lit("user").alias("kind"), "n"))


@query("k04_stored_threads", MEMBERS + "SELECT chat_id, thread_id, size FROM threads")
def k04(spark, d):
    base = fresh(spark, "threads")
    t = thread_table(spark, d)
    K.write_results({"threads": t, "totals": H.totals(t)}, base)
    return spark.read.parquet(f"{base}/threads").select("chat_id", "thread_id", "size")


def _stored_pairs(spark, df):
    base = fresh(spark, "pairs")
    side = lambda p: F.struct(F.col(f"{p}.id").alias("id"), F.col(f"{p}.text").alias("text"), F.date_format(f"{p}.ts", "yyyy-MM-dd'T'HH:mm:ssXXX").alias("date"))
    K.write_json_lines(df.select(side("a").alias("a"), side("b").alias("b"), "label", "time_delta_min", "same_author", "chat_id",
                                 (F.col("kind") == "hard").alias("hard_negative")), base)
    return S.read_pairs(spark, base)


_PAIR_SQL = "SELECT chat_id, a_id, b_id, label, round(delta, 6) AS time_delta_min, a_text, b_text FROM pairs"


def _pair_out(df):
    return df.select("chat_id", F.col("a.id").alias("a_id"), F.col("b.id").alias("b_id"), "label", F.round("time_delta_min", 6).alias("time_delta_min"),
                     F.col("a.text").alias("a_text"), F.col("b.text").alias("b_text"))


@query("s09_pair_lines", PAIRS + _PAIR_SQL)
def s09(spark, d):
    return _pair_out(_stored_pairs(spark, pairs(spark, d)))


@query("k11_holdout_lines", _ORDER + """, h AS (SELECT *, coalesce(sum(c) OVER (ORDER BY o, chat_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(c) OVER () AS t FROM sizes)
""" + _PAIR_SQL + " WHERE chat_id IN (SELECT chat_id FROM h WHERE before < t * 0.1)")
def k11(spark, d):
    return _pair_out(_stored_pairs(spark, P.split_holdout(pairs(spark, d))[1]))


@query("s10_labelled_csv", f"WITH {EVENT_MESSAGES} SELECT m.text, CAST(e.value >= 6 AS INT) AS label, count(*) AS n FROM messages m JOIN events e ON e.event_id = m.id GROUP BY 1, 2")
def s10(spark, d):
    base = fresh(spark, "csv")
    rates = table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("value").alias("review_rate"))
    K.write_csv(event_messages(spark, d).select("id", F.col("text").alias("review_text")).join(rates, "id"), base)
    read = S.read_labelled(spark, base, "review_text", "review_rate", S.threshold_label(6))
    return read.groupBy("text", "label").agg(F.count("*").alias("n"))


@query("k10_stored_transitions", TOKENS + "SELECT CAST(label AS BIGINT) AS label, count(*) AS pairs, round(sum(p), 4) AS mass FROM trans GROUP BY 1")
def k10(spark, d):
    base = fresh(spark, "transitions")
    K.write_results({"transitions": M.transitions(labelled_tokens(spark, d))}, base)
    return spark.read.parquet(f"{base}/transitions").groupBy("label").agg(F.count("*").alias("pairs"), F.round(F.sum("p"), 4).alias("mass"))


@query("k12_alarm_state", IN_RANGE + "SELECT alarm_id, max(id) AS last_analyzed_message_id, count(*) AS messages FROM inr WHERE alarm_id % 8 <> 7 GROUP BY 1")
def k12(spark, d):
    base = fresh(spark, "alarms")
    SA.run_alarms(_stream_messages(spark, d), alarms(spark, d), base, f"{base}/checkpoint").awaitTermination()
    return SA.alarm_state(spark, base).select("alarm_id", "last_analyzed_message_id", "messages")


@query("k09_stored_predictions", TOKENS + "SELECT doc_id, prediction FROM preds")
def k09(spark, d):
    from .scoring import sequence

    base = fresh(spark, "predictions")
    K.write_csv(sequence(spark, d).select("doc_id", "prediction"), base)
    return spark.read.option("header", True).schema("doc_id long, prediction long").csv(base)


_RUNS = "(VALUES (1::BIGINT), (2::BIGINT)) r(run)"


@query("s14b_saved_runs", f"""SELECT 'matches' AS name, run, count(*) AS n, CAST(sum(run - 1) AS BIGINT) AS scored FROM ({ORACLES['k02_stored_patterns']}), {_RUNS} GROUP BY run
UNION ALL SELECT 'edges', 1, CAST(sum(n) AS BIGINT), 0 FROM ({ORACLES['k03_stored_graph']}) WHERE kind <> 'user'
UNION ALL SELECT 'threads', run, count(*), 0 FROM ({ORACLES['k04_stored_threads']}), {_RUNS} GROUP BY run""")
def s14b(spark, d):
    """Two runs of results are saved, the second with a column more and without the graph, and put together again."""
    from ..operators.matches import extract_matches

    base = fresh(spark, "results")
    hits, threads = extract_matches(event_messages(spark, d), ["hashtags"]), thread_table(spark, d)
    K.save_run({"matches": hits, "edges": graph_parts(spark, d)[2], "threads": threads}, base, 1)
    K.save_run({"matches": hits.withColumn("score", F.lit(1.0)), "threads": threads}, base, 2)
    out = None
    for name, df in K.load_saved(spark, base).items():
        score = F.count("score") if "score" in df.columns else F.lit(0).cast("long")
        part = df.groupBy("run").agg(F.count("*").alias("n"), score.alias("scored")).select(F.lit(name).alias("name"), "run", "n", "scored")
        out = part if out is None else out.unionByName(part)
    return out
