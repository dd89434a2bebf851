"""Queries of alarms, windows and raw-export projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import alarms as A, matches as M, projections as P
from ..rules.patterns import BY_KEY, RULES
from ..sources import exports as S, sinks as K
from ..sources.store import MessageStore
from ..streaming import alarms as SA
from .extraction import _len, _q, hits_sql, re2
from .inputs import CONVERSATION_MESSAGES, EVENT_MESSAGES, conversation_messages, event_messages, table, text_table
from .registry import ORACLES, query

NOW = "2024-01-20 12:30:00"


def now():
    return F.to_timestamp(F.lit(NOW))


_SETS = [
    [("Precios", r"\d+ usd", "custom"), ("Hashtags", r"#\w+", "custom")],
    [("Correos", BY_KEY["emails"].regexes[0], "custom"), ("Verbo", r"vendo (\w+)", "custom"), ("Nada", r"zzzz", "custom")],
    [("Enlaces", r"https?://[^\s]+", "custom"), ("Todo", "", "global")],
]


def alarms(spark, d):
    """Alarms made from `nation`: one per row, over three pattern sets."""
    n = table(spark, d, "nation")
    k = F.col("n_nationkey").cast("long")
    sets = F.array(*[F.array(*[F.struct(F.lit(a).alias("name"), F.lit(b).alias("pattern"), F.lit(c).alias("type")) for a, b, c in s]) for s in _SETS])
    base = F.to_timestamp(F.lit("2024-01-01 00:00:00"))
    i = lambda c: c.cast("int")
    return n.select(
        k.alias("alarm_id"), (k % 10).alias("chat_id"), F.col("n_name").alias("chat_title"),
        F.struct(i(F.lit(0)).alias("months"), i(k % 3).alias("days"), i(k % 5).alias("hours"), i(k % 7).alias("minutes")).alias("interval"),
        F.timestamp_micros(F.unix_micros(base) + k * 3600000000).alias("date_from"),
        F.timestamp_micros(F.unix_micros(base) + (k * 12 + 48) * 3600000000).alias("date_to"),
        F.element_at(sets, (k % 3 + 1).cast("int")).alias("patterns"),
        F.lit(None).cast("long").alias("last_analyzed_message_id"),
        F.when(k % 4 != 0, F.timestamp_micros(F.unix_micros(base) + k * 86400000000)).alias("last_analysis_time"),
        (k % 6).alias("total_runs"), (k % 8 != 7).alias("enabled"), base.alias("created_at"),
        F.timestamp_micros(F.unix_micros(base) + (k + 8) * 86400000000).alias("next_run"))


ALARMS = """alarms AS (SELECT CAST(n_nationkey AS BIGINT) AS alarm_id, CAST(n_nationkey % 10 AS BIGINT) AS chat_id, n_name AS chat_title,
  CAST(n_nationkey AS BIGINT) AS k, CAST((n_nationkey % 3) * 1440 + (n_nationkey % 5) * 60 + n_nationkey % 7 AS BIGINT) AS raw_minutes,
  TIMESTAMP '2024-01-01' + to_hours(n_nationkey) AS date_from, TIMESTAMP '2024-01-01' + to_hours(n_nationkey * 12 + 48) AS date_to,
  CASE WHEN n_nationkey % 4 <> 0 THEN TIMESTAMP '2024-01-01' + to_days(CAST(n_nationkey AS INT)) END AS last_analysis_time,
  CAST(n_nationkey % 6 AS BIGINT) AS total_runs, n_nationkey % 8 <> 7 AS enabled, TIMESTAMP '2024-01-01' AS created_at,
  TIMESTAMP '2024-01-01' + to_days(CAST(n_nationkey AS INT) + 8) AS next_run FROM nation)"""
IN_RANGE = f"""WITH {EVENT_MESSAGES}, {ALARMS}, inr AS (SELECT a.alarm_id, a.k, a.chat_title, m.* FROM messages m JOIN alarms a USING (chat_id) WHERE m.ts BETWEEN a.date_from AND a.date_to)"""


def _alarm_hits_sql():
    parts, names = [], []
    for s, group in enumerate(_SETS):
        for no, (name, regex, kind) in enumerate(group):
            names.append(f"({s}, {no}, '{name}', '{kind}')")
            if regex:
                g = 1 if "(" in regex and "(?:" not in regex and "+(" not in regex and name == "Verbo" else 0
                parts.append(f"SELECT alarm_id, {no} AS pattern_no, '{name}' AS name, ts, id, generate_subscripts(a, 1) - 1 AS ord, unnest(a) AS value FROM "
                             f"(SELECT *, regexp_extract_all(text, {_q(re2(regex, True))}, {g}) AS a FROM inr WHERE k % 3 = {s})")
    return (f", allhits AS ({' UNION ALL '.join(parts)}), hits AS (SELECT * FROM allhits QUALIFY row_number() OVER (PARTITION BY alarm_id, pattern_no ORDER BY ts, id, ord) <= 10), "
            f"named AS (SELECT a.alarm_id, a.chat_title, v.* FROM alarms a JOIN (VALUES {', '.join(names)}) v(s, pattern_no, name, kind) ON a.k % 3 = v.s)")


HITS = IN_RANGE + _alarm_hits_sql()


def hits(spark, d, n=10):
    return A.extract(event_messages(spark, d), alarms(spark, d), n)


@query("w01_alarm_hits", HITS + " SELECT n.alarm_id, n.name, count(h.value) AS n, coalesce(string_agg(h.value, '|' ORDER BY h.ts, h.id, h.ord), '') AS found FROM named n LEFT JOIN hits h USING (alarm_id, pattern_no) GROUP BY 1, 2")
def w01(spark, d):
    a = alarms(spark, d)
    h = hits(spark, d)
    vals = h.groupBy("alarm_id", "pattern_no").agg(F.array_sort(F.collect_list(F.struct("ts", "id", "ord", "value"))).alias("s"))
    return A.counts_with_zero(h, a).join(vals, ["alarm_id", "pattern_no"], "left").select(
        "alarm_id", "name", "n", F.coalesce(F.array_join(F.transform("s", lambda x: x["value"]), "|"), F.lit("")).alias("found"))


def stored_messages(spark, d):
    """The event messages as a store cut by day and chat."""
    from ..session import new_table_path

    return MessageStore.create(event_messages(spark, d).select("chat_id", "id", "ts", "text"), new_table_path(spark, "store"), buckets=4)


@query("w01b_stored_alarm_hits", HITS + " SELECT alarm_id, name, id, ord, value FROM hits")
def w01b(spark, d):
    h = A.extract(stored_messages(spark, d), alarms(spark, d))
    return h.select("alarm_id", "name", "id", F.col("ord").cast("long").alias("ord"), "value")


@query("w03_link_labels", HITS + """ SELECT h.alarm_id, h.id, CASE WHEN h.name <> 'Enlaces' THEN h.value WHEN starts_with(h.value, 'https://tienda.') THEN '[🔗 Enlace a Example]'
  WHEN starts_with(h.value, 'https://github.') THEN '[🐛 Issue de GitHub de ' || regexp_extract(h.value, 'com/(u[0-9]+)/', 1) || '/r - Archivo: ' || regexp_extract(h.value, '([0-9]+)$', 1) || ']'
  ELSE '[🎥 Video de YouTube - ID: ' || regexp_extract(h.value, 'v=(.*)$', 1) || ']' END AS value FROM hits h""")
def w03(spark, d):
    return A.extract(event_messages(spark, d), alarms(spark, d), 10, label=A.link_labels).select("alarm_id", "id", "value")


_GLOBAL = " UNION ALL ".join(
    f"SELECT alarm_id, 'Global_{r.key}' AS name, ts, id, generate_subscripts(a, 1) - 1 AS ord, unnest(a) AS value FROM (SELECT *, {hits_sql(r)} AS a FROM inr WHERE k % 3 = 2)" for r in RULES)


@query("w02_global_extractor", IN_RANGE + f", g AS ({_GLOBAL}) SELECT alarm_id, name, id, value FROM g QUALIFY row_number() OVER (PARTITION BY alarm_id, name ORDER BY ts, id, ord) <= 5")
def w02(spark, d):
    return A.extract_all_keys(event_messages(spark, d), alarms(spark, d)).select("alarm_id", "name", "id", "value")


@query("w04_alarm_digest", HITS + """, v AS (SELECT alarm_id, pattern_no, value, count(*) AS qty, min({'ts': ts, 'id': id, 'ord': ord}) AS pos FROM hits GROUP BY 1, 2, 3),
l AS (SELECT alarm_id, pattern_no, string_agg(CASE WHEN qty > 1 THEN value || ' (' || qty || ' veces)' ELSE value END, ', ' ORDER BY pos, value) AS listing, CAST(sum(qty) AS BIGINT) AS n FROM v GROUP BY 1, 2)
SELECT n.alarm_id, n.name, coalesce(l.n, 0) AS n, '  • ' || n.name || ' (' || n.kind || '): ' || coalesce(l.n, 0) || ' encontrados' AS head,
  CASE WHEN l.n > 0 THEN '    → encontrados: ' || listing ELSE '' END AS detail FROM named n LEFT JOIN l USING (alarm_id, pattern_no)""")
def w04(spark, d):
    return A.digest(hits(spark, d), alarms(spark, d)).select("alarm_id", "name", "n", "head", "detail")


@query("w04b_alarm_report", HITS + """, v AS (SELECT alarm_id, pattern_no, value, count(*) AS qty, min({'ts': ts, 'id': id, 'ord': ord}) AS pos FROM hits GROUP BY 1, 2, 3),
l AS (SELECT alarm_id, pattern_no, string_agg(CASE WHEN qty > 1 THEN value || ' (' || qty || ' veces)' ELSE value END, ', ' ORDER BY pos, value) AS listing, sum(qty) AS n FROM v GROUP BY 1, 2),
x AS (SELECT n.alarm_id, n.chat_title, n.pattern_no, coalesce(l.n, 0) AS n, '  • ' || n.name || ' (' || n.kind || '): ' || coalesce(l.n, 0) || ' encontrados'
  || CASE WHEN l.n > 0 THEN chr(10) || '    → encontrados: ' || listing ELSE '' END AS line FROM named n LEFT JOIN l USING (alarm_id, pattern_no))
SELECT alarm_id, '🔔 RESUMEN DE ALARMA: ' || chat_title || chr(10) || '📅 20/01/2024 12:30' || chr(10) || '🆔 Alarma ID: ' || alarm_id || chr(10) || chr(10) || '📊 RESULTADOS POR PATRÓN:' || chr(10)
  || string_agg(line, chr(10) ORDER BY pattern_no) || chr(10) || chr(10) || '📈 Total de coincidencias: ' || CAST(sum(n) AS BIGINT) || chr(10) || chr(10) || '⏰ Próxima revisión según intervalo configurado' AS message
FROM x GROUP BY alarm_id, chat_title""")
def w04b(spark, d):
    a = alarms(spark, d)
    return A.report(A.digest(hits(spark, d), a), a, now())


_NEXT = f"make_timestamp(epoch_us(base) + greatest(1, CAST(floor((epoch_us(TIMESTAMP '{NOW}') - epoch_us(base)) / (m * 60000000)) AS BIGINT) + 1) * m * 60000000)"


@query("w05_alarm_advance", IN_RANGE + f""", s AS (SELECT alarm_id, max(id) AS top, count(*) AS seen FROM inr GROUP BY 1),
b AS (SELECT a.*, s.top, s.seen, TIMESTAMP '{NOW}' AS base, greatest(raw_minutes, 1) AS m FROM alarms a LEFT JOIN s USING (alarm_id))
SELECT alarm_id, top AS last_id, total_runs + 1 AS total_runs, epoch_us(date_to) AS date_from, epoch_us(TIMESTAMP '{NOW}') AS date_to, epoch_us({_NEXT}) AS next_run, coalesce(seen, 0) > 0 AS updated FROM b""")
def w05(spark, d):
    s = A.advance(alarms(spark, d), stored_messages(spark, d), now())
    return s.select("alarm_id", F.col("last_analyzed_message_id").alias("last_id"), "total_runs", F.unix_micros("date_from").alias("date_from"),
                    F.unix_micros("date_to").alias("date_to"), F.unix_micros("next_run").alias("next_run"), "updated")


@query("w06_high_water_mark", IN_RANGE + "SELECT a.alarm_id, max(i.id) AS last_id, count(i.id) AS messages FROM alarms a LEFT JOIN inr i USING (alarm_id) GROUP BY 1")
def w06(spark, d):
    seen = A.in_range(stored_messages(spark, d), alarms(spark, d)).groupBy("alarm_id").agg(F.max("id").alias("last_id"), F.count("*").alias("messages"))
    return alarms(spark, d).select("alarm_id").join(seen, "alarm_id", "left").select("alarm_id", "last_id", F.coalesce("messages", F.lit(0)).alias("messages"))


@query("w07_next_run", f"""WITH {ALARMS}, b AS (SELECT *, coalesce(last_analysis_time, created_at) AS base, raw_minutes AS m FROM alarms)
SELECT alarm_id, CASE WHEN m > 0 THEN epoch_us({_NEXT.replace('(m * 60000000)', '(greatest(m, 1) * 60000000)')}) END AS next_run FROM b""")
def w07(spark, d):
    base = F.coalesce("last_analysis_time", "created_at")
    return alarms(spark, d).select("alarm_id", F.unix_micros(A.next_run(base, A.interval_minutes("interval", floor=False), now())).alias("next_run"))


@query("w08_interval_minutes", f"WITH {ALARMS} SELECT alarm_id, CAST(greatest(raw_minutes, 1) AS BIGINT) AS minutes FROM alarms")
def w08(spark, d):
    return alarms(spark, d).select("alarm_id", A.interval_minutes("interval", months=True).alias("minutes"))


@query("w09_alarm_status", f"""WITH {ALARMS}, t AS (SELECT *, CAST(floor((epoch_us(next_run) - epoch_us(TIMESTAMP '{NOW}')) / 1000000) AS BIGINT) AS s FROM alarms)
SELECT alarm_id, chat_title AS title, enabled, total_runs, strftime(next_run, '%d/%m/%Y %H:%M') AS next_run,
 CASE WHEN s <= 0 THEN 'Ahora' ELSE CASE WHEN s // 86400 > 0 THEN (s // 86400) || 'd ' ELSE '' END || CASE WHEN s % 86400 // 3600 > 0 OR s // 86400 > 0 THEN (s % 86400 // 3600) || 'h ' ELSE '' END || (s % 3600 // 60) || 'm' END AS time_left,
 CAST([2, 3, 2][k % 3 + 1] AS BIGINT) AS patterns, coalesce(strftime(last_analysis_time, '%d/%m/%Y %H:%M'), 'Nunca') AS last_run FROM t""")
def w09(spark, d):
    return A.status(alarms(spark, d), now())


@query("w10_due_alarms", f"WITH {ALARMS} SELECT alarm_id FROM alarms WHERE enabled AND next_run <= TIMESTAMP '{NOW}'")
def w10(spark, d):
    return A.due(alarms(spark, d), now()).select("alarm_id")


@query("w11_no_updates", IN_RANGE + " SELECT alarm_id, 'Sin novedades en ' || chat_title AS notice FROM alarms WHERE alarm_id NOT IN (SELECT alarm_id FROM inr)")
def w11(spark, d):
    return A.no_updates(alarms(spark, d), stored_messages(spark, d))


@query("w12_unread_counts", f"WITH {EVENT_MESSAGES}, {ALARMS} SELECT chat_id, count(*) AS unread, chat_id IN (SELECT chat_id FROM alarms WHERE enabled) AS alarm_hit FROM messages GROUP BY 1")
def w12(spark, d):
    return A.unread_counts(event_messages(spark, d), alarms(spark, d))


@query("w13_notifications", f"WITH {EVENT_MESSAGES} SELECT id, '📨 Nuevo mensaje en Chat ' || chat_id || ': ' || substr(text, 1, 50) || '...' AS notice FROM messages")
def w13(spark, d):
    m = event_messages(spark, d)
    return m.select("id", A.notification(F.concat(F.lit("Chat "), F.col("chat_id").cast("string")), F.col("text")).alias("notice"))


_STREAM_KEYS = ["hashtags", "emails", "monedas_explicitas"]
_STREAM = " UNION ALL ".join(
    f"SELECT id, '{k}' AS key, CAST(generate_subscripts(a, 1) - 1 AS BIGINT) AS ord, unnest(a) AS value FROM (SELECT id, {hits_sql(BY_KEY[k])} AS a FROM messages)" for k in _STREAM_KEYS)


def _stream_messages(spark, d):
    """The event messages as a stream over the parquet file."""
    from .inputs import as_event_messages

    schema = table(spark, d, "events").schema
    return as_event_messages(SA.read_message_stream(spark, f"{d}/events.parquet*", schema))


def _run_once(df, name):
    """Run a stream over what is there and read back what it wrote."""
    from ..session import new_table_path

    base = new_table_path(df.sparkSession, name)
    SA.write_hits(df, f"{base}/table", f"{base}/checkpoint").awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{base}/table")


@query("w14_pattern_stream", f"WITH {EVENT_MESSAGES} {_STREAM}")
def w14(spark, d):
    hits = SA.pattern_stream(_stream_messages(spark, d), keys=_STREAM_KEYS)
    return _run_once(hits.select("id", "key", F.col("ord").cast("long").alias("ord"), "value"), "pattern_stream")


@query("w17_deduplicated_stream", f"WITH {EVENT_MESSAGES} SELECT chat_id, id FROM messages")
def w17(spark, d):
    return _run_once(SA.deduplicated(_stream_messages(spark, d)).select("chat_id", "id"), "deduplicated")


LATE_PARTS, LATE_DELAY = 3, "3 days"
_LATE = f"""WITH {EVENT_MESSAGES}, p AS (SELECT *, id % {LATE_PARTS} AS part FROM messages),
tops AS (SELECT part, max(ts) AS top FROM p GROUP BY 1),
marks AS (SELECT a.part, max(b.top) - INTERVAL {LATE_DELAY} AS mark FROM tops a LEFT JOIN tops b ON b.part < a.part GROUP BY 1)"""


def _late_run(spark, d):
    """The event messages as a stream of three fetches that each span the whole time; returns its folder and schema."""
    from ..session import new_table_path

    base, m = new_table_path(spark, "late"), event_messages(spark, d).select("chat_id", "id", "ts")
    for part in range(LATE_PARTS):  # files are read in the order of their writing
        m.filter(F.col("id") % LATE_PARTS == part).coalesce(1).write.parquet(f"{base}/in/part{part}")
    stream = SA.read_message_stream(spark, f"{base}/in/*", m.schema, files_per_batch=1)
    SA.write_in_time(stream, base, f"{base}/checkpoint", LATE_DELAY).awaitTermination()
    return base, m.schema


@query("w17b_late_rows", _LATE + " SELECT part, chat_id, count(*) AS n, min(id) AS first_id, max(id) AS last_id FROM p JOIN marks USING (part) WHERE ts <= mark GROUP BY 1, 2")
def w17b(spark, d):
    late = SA.late_table(spark, *_late_run(spark, d))
    return late.groupBy((F.col("id") % LATE_PARTS).alias("part"), "chat_id").agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


@query("w17c_rows_in_time", _LATE + " SELECT chat_id, count(*) AS n, max(id) AS last_id FROM p JOIN marks USING (part) WHERE mark IS NULL OR ts > mark GROUP BY 1")
def w17c(spark, d):
    base, schema = _late_run(spark, d)
    table = spark.read.schema(schema).option("basePath", f"{base}/table").parquet(f"{base}/table")
    return table.groupBy("chat_id").agg(F.count("*").alias("n"), F.max("id").alias("last_id"))


@query("w15_hourly_windows", f"WITH {EVENT_MESSAGES} SELECT chat_id, epoch_us(date_trunc('hour', ts)) AS start, count(*) AS n FROM messages GROUP BY 1, 2")
def w15(spark, d):
    return SA.hourly_windows(event_messages(spark, d), delay="").select("chat_id", F.unix_micros("start").alias("start"), "n")


@query("w15b_sliding_windows", f"""WITH {EVENT_MESSAGES}, w AS (SELECT chat_id, ts, unnest([0, 1]) AS k FROM messages)
SELECT chat_id, epoch_us(time_bucket(INTERVAL 30 MINUTES, ts) - to_minutes(30 * k)) AS start, count(*) AS n FROM w GROUP BY 1, 2""")
def w15b(spark, d):
    return SA.hourly_windows(event_messages(spark, d), delay="", slide="30 minutes").select("chat_id", F.unix_micros("start").alias("start"), "n")


@query("w15c_session_windows", f"""WITH {EVENT_MESSAGES}, g AS (SELECT chat_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS new FROM messages WINDOW w AS (PARTITION BY chat_id ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY chat_id ORDER BY ts) AS sid FROM g)
SELECT chat_id, epoch_us(min(ts)) AS start, epoch_us(max(ts)) + 1800000000 AS "end", count(*) AS n FROM s GROUP BY chat_id, sid""")
def w15c(spark, d):
    return SA.bursts(event_messages(spark, d), delay="").select("chat_id", F.unix_micros("start").alias("start"), F.unix_micros("end").alias("end"), "n")


@query("w16_duplicate_suppression", f"WITH {EVENT_MESSAGES} SELECT chat_id, count(DISTINCT id) AS n FROM messages GROUP BY 1")
def w16(spark, d):
    m = event_messages(spark, d)
    return m.unionByName(m).dropDuplicates(["chat_id", "id"]).groupBy("chat_id").agg(F.count("*").alias("n"))


def _run_whole(df, name):
    """Run a grouped stream over what is there and read back its whole result."""
    from ..session import new_table_path

    base = new_table_path(df.sparkSession, name)
    SA.write_whole(df, f"{base}/table", f"{base}/checkpoint").awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{base}/table")


@query("w12b_unread_stream", ORACLES["w12_unread_counts"])
def w12b(spark, d):
    return _run_whole(SA.unread_stream(SA.deduplicated(_stream_messages(spark, d)), alarms(spark, d)), "unread")


@query("w15d_hourly_stream", ORACLES["w15_hourly_windows"])
def w15d(spark, d):
    return _run_whole(SA.hourly_windows(_stream_messages(spark, d)), "hourly").select("chat_id", F.unix_micros("start").alias("start"), "n")


@query("w15e_sliding_stream", ORACLES["w15b_sliding_windows"])
def w15e(spark, d):
    return _run_whole(SA.hourly_windows(_stream_messages(spark, d), slide="30 minutes"), "sliding").select("chat_id", F.unix_micros("start").alias("start"), "n")


@query("w15f_session_stream", ORACLES["w15c_session_windows"])
def w15f(spark, d):
    s = _run_whole(SA.bursts(_stream_messages(spark, d)), "sessions")
    return s.select("chat_id", F.unix_micros("start").alias("start"), F.unix_micros("end").alias("end"), "n")


@query("w16b_duplicates_of_a_stream", ORACLES["w16_duplicate_suppression"])
def w16b(spark, d):
    """Two fetches whose ranges overlap, as a stream with one copy of each message."""
    from ..session import new_table_path

    base, m = new_table_path(spark, "overlap"), event_messages(spark, d).select("chat_id", "id", "ts")
    for part, ids in enumerate((F.col("id") % 3 < 2, F.col("id") % 3 > 0)):
        m.filter(ids).write.parquet(f"{base}/in/part{part}")
    stream = SA.read_message_stream(spark, f"{base}/in/*", m.schema)
    return _run_once(SA.deduplicated(stream, "90 days").select("chat_id", "id"), "one_copy").groupBy("chat_id").agg(F.count("*").alias("n"))


@query("w18_normalized_alarms", f"""WITH {ALARMS} SELECT alarm_id, epoch_us(date_from) AS date_from, epoch_us(date_to) AS date_to,
 epoch_us(CASE WHEN enabled AND raw_minutes > 0 THEN TIMESTAMP '{NOW}' ELSE next_run END) AS next_run, epoch_us(CASE WHEN NOT (enabled AND raw_minutes > 0) THEN last_analysis_time END) AS last_run FROM alarms""")
def w18(spark, d):
    n = A.normalize(alarms(spark, d), now())
    return n.select("alarm_id", *[F.unix_micros(c).alias(c) for c in ("date_from", "date_to", "next_run")], F.unix_micros("last_analysis_time").alias("last_run"))


# ---- scans and projections on the same tables -------------------------------------------------


@query("s06_day_range", f"WITH {EVENT_MESSAGES} SELECT id FROM messages WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-09'")
def s06(spark, d):
    return stored_messages(spark, d).between_days("2024-01-05", "2024-01-09").select("id")


@query("s07_time_range", f"WITH {EVENT_MESSAGES} SELECT id FROM messages WHERE ts BETWEEN TIMESTAMP '2024-01-05 10:00:00' AND TIMESTAMP '2024-01-06 09:00:00'")
def s07(spark, d):
    return stored_messages(spark, d).between_times("2024-01-06 09:00:00", "2024-01-05 10:00:00").select("id")


@query("s06b_day_range_of_a_table", f"WITH {EVENT_MESSAGES} SELECT id FROM messages WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-09'")
def s06b(spark, d):
    return S.between_days(event_messages(spark, d), "2024-01-05", "2024-01-09").select("id")


@query("s07b_time_range_of_a_table", f"WITH {EVENT_MESSAGES} SELECT id FROM messages WHERE ts BETWEEN TIMESTAMP '2024-01-05 10:00:00' AND TIMESTAMP '2024-01-06 09:00:00'")
def s07b(spark, d):
    return S.between_times(event_messages(spark, d), "2024-01-06 09:00:00", "2024-01-05 10:00:00").select("id")


@query("s06c_grown_store", f"WITH {EVENT_MESSAGES} SELECT chat_id, count(*) AS n, count(DISTINCT id) AS ids FROM messages WHERE chat_id IN (2, 7) GROUP BY 1")
def s06c(spark, d):
    """A store filled by two fetches whose ranges overlap."""
    from ..session import new_table_path

    m = event_messages(spark, d).select("chat_id", "id", "ts", "text")
    cut = F.col("id") % 3
    store = MessageStore.create(m.filter(cut < 2), new_table_path(spark, "store"), buckets=4)
    store.append(m.filter(cut > 0))
    return store.of_chats(2, 7).groupBy("chat_id").agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"))


@query("s08_latest_previews", f"WITH {EVENT_MESSAGES} SELECT chat_id, id FROM messages WHERE length(trim(text)) > 0 QUALIFY row_number() OVER (PARTITION BY chat_id ORDER BY ts DESC, id DESC) <= 50")
def s08(spark, d):
    return P.latest_previews(event_messages(spark, d)).select("chat_id", "id")


@query("s11_truthy_labels", """SELECT doc_id, CASE WHEN quality = 1 THEN 1 ELSE 0 END AS label, CASE WHEN toxic = 1 THEN 'positivo' ELSE 'no' END = 'positivo' AS word_label FROM labels""")
def s11(spark, d):
    t = table(spark, d, "labels")
    word = F.when(F.col("toxic") == 1, "positivo").otherwise("no")
    return t.select("doc_id", S.truthy_label(F.col("quality").cast("string")).alias("label"), (S.truthy_label(word) == 1).alias("word_label"))


@query("s12_threshold_labels", "SELECT event_id, CAST(value >= 6 AS INT) AS at_least, CAST(value > 6 AS INT) AS above FROM events")
def s12(spark, d):
    v = F.col("value").cast("string")
    return table(spark, d, "events").select("event_id", S.threshold_label(6)(v).alias("at_least"), S.threshold_label(6, True)(v).alias("above"))


@query("s13_all_messages", f"""WITH {EVENT_MESSAGES}, c AS (SELECT conv_id FROM conversations) SELECT 'events' AS source, count(*) AS n FROM messages UNION ALL SELECT 'conversations', count(*) FROM c""")
def s13(spark, d):
    cols = ["chat_id", "id", "sender_name", "ts", "text"]
    e = event_messages(spark, d).select(*cols).withColumn("source", F.lit("events"))
    return e.unionByName(conversation_messages(spark, d).select(*cols).withColumn("source", F.lit("conversations"))).groupBy("source").agg(F.count("*").alias("n"))


@query("s14_saved_results", """WITH m AS (SELECT conv_id % 10 AS chat_id, count(*) AS messages FROM conversations GROUP BY 1), e AS (SELECT user_id % 10 AS chat_id, count(*) AS events FROM events GROUP BY 1)
SELECT chat_id, messages, coalesce(events, 0) AS events FROM m LEFT JOIN e USING (chat_id)""")
def s14(spark, d):
    m = conversation_messages(spark, d).groupBy("chat_id").agg(F.count("*").alias("messages"))
    e = event_messages(spark, d).groupBy("chat_id").agg(F.count("*").alias("events"))
    return m.join(e, "chat_id", "left").select("chat_id", "messages", F.coalesce("events", F.lit(0)).alias("events"))


_RAW = """raw AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN c_custkey END AS user_id, CASE WHEN c_custkey % 3 = 1 THEN c_custkey END AS pchat, CASE WHEN c_custkey % 3 = 2 THEN c_custkey END AS channel,
  CASE WHEN c_custkey % 4 = 0 THEN c_mktsegment END AS title, CASE WHEN c_custkey % 5 <> 0 THEN c_name END AS first, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS last,
  CASE WHEN c_custkey % 3 <> 1 THEN lower(c_mktsegment) || c_custkey END AS username FROM customer)"""


def raw(spark, d):
    """`customer` as raw sender records with every kind of gap."""
    k = F.col("c_custkey")
    w = lambda cond, v: F.when(cond, v)
    return table(spark, d, "customer").select(
        k.alias("id"), F.struct(w(k % 3 == 0, k).alias("user_id"), w(k % 3 == 1, k).alias("chat_id"), w(k % 3 == 2, k).alias("channel_id")).alias("peer"),
        w(k % 4 == 0, F.col("c_mktsegment")).alias("title"), w(k % 5 != 0, F.col("c_name")).alias("first"), w(k % 2 == 0, F.col("c_mktsegment")).alias("last"),
        w(k % 3 != 1, F.concat(F.lower("c_mktsegment"), k.cast("string"))).alias("username"))


@query("p01_sender_resolution", f"WITH {_RAW} SELECT id, coalesce(user_id, pchat, channel) AS sender_id, coalesce(title, concat_ws(' ', first, last)) AS sender_name FROM raw")
def p01(spark, d):
    return raw(spark, d).select("id", P.sender_id(F.col("peer")).alias("sender_id"), P.sender_name("title", "first", "last").alias("sender_name"))


@query("p02_alarm_sender", f"WITH {_RAW} SELECT id, coalesce(username, first, CAST(id AS VARCHAR), 'unknown') AS sender FROM raw")
def p02(spark, d):
    return raw(spark, d).select("id", P.alarm_sender("username", "first", "id").alias("sender"))


@query("p03_preview_sender", f"WITH {_RAW} SELECT id, coalesce(nullif(concat_ws(' ', first, last), ''), title, '@' || username, '') AS sender FROM raw")
def p03(spark, d):
    return raw(spark, d).select("id", P.preview_sender("first", "last", "title", "username").alias("sender"))


@query("p04_reaction_map", """SELECT event_id AS id, event_type AS emoji, CAST(json_extract(props, '$.k') AS BIGINT) AS n FROM events WHERE event_type <> 'error'""")
def p04(spark, d):
    e = table(spark, d, "events")
    k = F.get_json_object("props", "$.k").try_cast("long")
    r = F.array(F.struct(F.when(F.col("event_type") != "error", F.col("event_type")).alias("emoticon"), k.alias("count")))
    return e.select(F.col("event_id").alias("id"), F.explode(P.reaction_map(r)).alias("emoji", "n"))


@query("p05_mentions", f"WITH {EVENT_MESSAGES} SELECT id, CASE WHEN id % 2 = 0 THEN sender_id END AS user_id, substr(text, 1, 5) AS mention FROM messages")
def p05(spark, d):
    m = event_messages(spark, d)
    ent = F.array(F.struct(F.when(F.col("id") % 2 == 0, F.col("sender_id")).alias("user_id"), F.lit(0).alias("offset"), F.lit(5).alias("length")))
    x = m.select("id", F.explode(P.mentions("text", ent)).alias("m"))
    return x.select("id", "m.user_id", F.col("m.text").alias("mention"))


@query("p06_reply_flatten", f"WITH {CONVERSATION_MESSAGES} SELECT id, reply_id FROM messages")
def p06(spark, d):
    m = conversation_messages(spark, d).select("id", F.struct(F.col("reply_id").alias("reply_to_msg_id")).alias("reply_to"))
    return m.select("id", F.col("reply_to.reply_to_msg_id").alias("reply_id"))


@query("p07_media_descriptor", """SELECT event_id AS id, CASE event_type WHEN 'view' THEN 'photo' WHEN 'click' THEN 'audio' WHEN 'purchase' THEN 'audio' WHEN 'signup' THEN 'document' END AS type,
  CASE event_type WHEN 'view' THEN 'photo_' || event_id || '.jpg' WHEN 'click' THEN 'audio_' || event_id || '.ogg' WHEN 'purchase' THEN 'audio_' || event_id || '.mp3' WHEN 'signup' THEN event_id || '_factura.pdf' END AS filename FROM events""")
def p07(spark, d):
    e = table(spark, d, "events")
    t = F.col("event_type")
    kind = F.when(t == "view", "photo").when(t.isin("click", "purchase", "signup"), "document")
    attr = F.array(F.struct(F.when(t == "purchase", "audio/mpeg").alias("mime_type"), (t == "click").alias("voice"), F.when(t == "signup", "factura.pdf").alias("file_name")))
    x = e.select(F.col("event_id").alias("id"), P.media("event_id", kind, attr).alias("m"))
    return x.select("id", "m.type", "m.filename")


@query("p08_chat_categories", """WITH c AS (SELECT c_custkey AS id, CASE WHEN c_custkey = 7 THEN '💾 Mensajes guardados' ELSE c_name END AS name, CASE c_custkey % 3 WHEN 0 THEN 'user' WHEN 1 THEN 'chat' ELSE 'channel' END AS kind,
  c_custkey = 7 AS own, c_custkey % 4 AS unread, r_name AS folder FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey)
SELECT id, name, 'all' AS category FROM c UNION ALL SELECT id, name, 'unread' FROM c WHERE unread > 0 UNION ALL SELECT id, name, 'saved' FROM c WHERE own
UNION ALL SELECT id, name, CASE WHEN kind = 'user' AND NOT own THEN 'personal' ELSE 'groups' END FROM c WHERE NOT (own AND kind = 'user') UNION ALL SELECT id, name, 'folder:' || folder FROM c""")
def p08(spark, d):
    k = F.col("c_custkey")
    folders = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_nationkey").alias("folder_id"), F.col("r_name").alias("folder_name"))
    chats = table(spark, d, "customer").select(
        k.alias("id"), F.col("c_name").alias("name"), F.when(k % 3 == 0, "user").when(k % 3 == 1, "chat").otherwise("channel").alias("kind"),
        (k == 7).alias("is_self"), (k % 4).alias("unread_count"), F.col("c_nationkey").alias("folder_id"))
    return P.chat_categories(chats, folders).select("id", "name", "category")


@query("p09_chat_names", f"WITH {_RAW} SELECT id, coalesce(title, nullif(concat_ws(' ', first, last), ''), username) AS name FROM raw")
def p09(spark, d):
    return raw(spark, d).select("id", P.chat_name("title", "first", "last", "username").alias("name"))


@query("p10_user_names", f"""WITH {_RAW} SELECT id, CASE WHEN first IS NOT NULL AND username IS NOT NULL THEN first || ' @' || username WHEN first IS NOT NULL THEN first WHEN username IS NOT NULL THEN '@' || username ELSE 'Usuario ' || id END AS name FROM raw""")
def p10(spark, d):
    return raw(spark, d).select("id", P.user_display_name("first", "username", "id").alias("name"))


@query("p11_file_names", """SELECT page_id, regexp_replace(url, '[<>:"/\\\\|?*]', '_', 'g') AS name FROM pages""")
def p11(spark, d):
    return table(spark, d, "pages").select("page_id", X.sanitize_filename("url").alias("name"))


@query("p12_clean_text", "SELECT doc_id, trim(regexp_replace(text, '[^\\p{L}\\p{N}\\p{M}_\\s.,!?¿¡]', '', 'g'), ' ') AS clean FROM documents")
def p12(spark, d):
    return text_table(spark, d, "documents", "doc_id", "text").select("doc_id", X.clean_for_analysis("text").alias("clean"))


_STRIP = "html"
for _a, _b in [(r"(?is)<script\b[^>]*>.*?</script\s*>", " "), (r"(?is)<style\b[^>]*>.*?</style\s*>", " "), (r"(?s)<!--.*?-->", " "), (r"(?s)<!?/?[A-Za-z][^>]*>", " "),
               (r"!\[([^\]]*)\]\([^)]*\)", r"\1"), (r"\[([^\]]*)\]\([^)]*\)", r"\1"), (r"(?m)^\s{0,3}(#{1,6}|>|[-*+])\s+", ""), (r"(\*\*|__|~~|`+)", ""), (r"&nbsp;|&#160;", " "),
               (r"&lt;", "<"), (r"&gt;", ">"), (r"&quot;|&#34;", '"'), (r"&#39;|&apos;", "'"), (r"&amp;", "&"), (r"\s+", " ")]:
    _STRIP = f"regexp_replace({_STRIP}, {_q(_a)}, {_q(_b)}, 'g')"


@query("p14_strip_markup", f"SELECT page_id, trim({_STRIP}) AS text FROM pages")
def p14(spark, d):
    return text_table(spark, d, "pages", "page_id", "html").select("page_id", X.strip_markup("html").alias("text"))


@query("p15_truncated", f"""WITH {EVENT_MESSAGES} SELECT id, CASE WHEN length(text) > 80 THEN substr(text, 1, 80) || '...' ELSE text END AS short FROM messages""")
def p15(spark, d):
    return event_messages(spark, d).select("id", X.truncate("text", 80).alias("short"))


@query("p16_has_media", "SELECT event_type IN ('view', 'click') AS has_media, count(*) AS n FROM events GROUP BY 1")
def p16(spark, d):
    e = table(spark, d, "events")
    m = F.when(F.col("event_type").isin("view", "click"), F.struct(F.lit("photo").alias("type")))
    return e.select(m.alias("media")).groupBy(F.col("media.type").isNotNull().alias("has_media")).agg(F.count("*").alias("n"))


@query("p17_preview_lines", f"""WITH {EVENT_MESSAGES} SELECT id, strftime(ts, '%Y-%m-%d %H:%M') || ' — ' || sender_name || ': ' || text
  || CASE id % 3 WHEN 0 THEN '' WHEN 1 THEN ' [Media: foto.jpg]' ELSE ' [Media: no descargado]' END AS line FROM messages""")
def p17(spark, d):
    m = event_messages(spark, d)
    media = F.when(F.col("id") % 3 == 1, F.struct(F.lit(True).alias("downloaded"), F.lit("foto.jpg").alias("filename"))).when(
        F.col("id") % 3 == 2, F.struct(F.lit(False).alias("downloaded"), F.lit("foto.jpg").alias("filename")))
    return m.select("id", P.preview_line(F.date_format("ts", "yyyy-MM-dd HH:mm"), F.col("sender_name"), F.col("text"), media).alias("line"))


@query("k07_dataset_signature", """WITH f AS (SELECT source AS file, count(*) AS c FROM documents GROUP BY 1)
SELECT string_agg(file, ',' ORDER BY file) AS files, CAST(sum(c) AS BIGINT) AS total_messages, 'hash' AS model FROM f""")
def k07(spark, d):
    from ..operators.pairs import signature

    m = table(spark, d, "documents").select(F.col("source").alias("file"))
    return signature(m, "hash", max_prev=10, neg_ratio=2).select(F.array_join("files", ",").alias("files"), "total_messages", "model")


@query("k08_pending_rows", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def k08(spark, d):
    return K.pending(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), ["doc_id"])


@query("k05_iso_report", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || 'Z' AS ts FROM events")
def k05(spark, d):
    from ..operators.reports import iso_strings

    return iso_strings(event_messages(spark, d).select(F.col("id").alias("event_id"), "ts"))
