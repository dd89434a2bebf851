"""Queries of the reply graph and of threads, on conversations as chats."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import STOP_WORDS
from ..operators import graph as G, threads as H
from ..rules.patterns import RULES
from ..session import materialize
from .extraction import hits_sql
from .inputs import CONVERSATION_MESSAGES, EVENT_MESSAGES, conversation_messages, event_messages, table
from .registry import query

_STORED: dict = {}


def stored(spark, d, name, build):
    """Tables of the graph are written once per session and read by every later query."""
    key = (spark.sparkContext.applicationId, d, name)
    if key not in _STORED:
        _STORED[key] = materialize(build(), name)
    return _STORED[key]


def forget_stored() -> None:
    _STORED.clear()


def messages(spark, d):
    return conversation_messages(spark, d)


def nodes(spark, d):
    return stored(spark, d, "message_nodes", lambda: G.message_nodes(messages(spark, d)))


def replies(spark, d):
    def build():
        return G.explicit_edges(messages(spark, d)).unionByName(G.likely_edges(nodes(spark, d)))

    return stored(spark, d, "reply_edges", build)


def members(spark, d):
    return stored(spark, d, "thread_members", lambda: G.thread_members(messages(spark, d), replies(spark, d)))


def rows(spark, d):
    return H.thread_rows(members(spark, d), nodes(spark, d), "ts", "user_key", "intention", "text")


def thread_table(spark, d):
    return G.threads(members(spark, d), nodes(spark, d))


_INTENT = """CASE WHEN contains(low, '?') OR contains(low, '¿') THEN 'question'
  WHEN contains(low, 'vendo') OR contains(low, 'disponible') OR contains(low, 'tengo') THEN 'offer'
  WHEN contains(low, 'busco') OR contains(low, 'necesito') OR contains(low, 'compro') THEN 'request'
  WHEN contains(low, 'gracias') OR contains(low, 'thank') THEN 'gratitude'
  WHEN contains(low, 'hola') OR contains(low, 'hi') OR contains(low, 'hello') OR contains(low, 'buenos') THEN 'greeting'
  WHEN regexp_matches(low, '\\b(dec(ir|imos)|dig[oa]|dice[ns]?|inform(ar|o|a|an|amos)|comunic(ar|o|a|an|amos))\\b') THEN 'information'
  ELSE 'statement' END"""
_PATTERNS = "list_distinct(flatten([" + ", ".join(
    f"list_transform({hits_sql(r)}, lambda v: '{r.key}=' || v)" for r in RULES) + "]))"
_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
NODES = f"""WITH RECURSIVE {CONVERSATION_MESSAGES},
low AS (SELECT *, lower(text) AS low FROM messages),
nodes AS (SELECT *, {_INTENT} AS intention,
   list_distinct(list_filter(regexp_extract_all(low, '[\\p{{L}}\\p{{N}}_]+'), lambda x: x NOT IN ({_STOP}))) AS words,
   {_PATTERNS} AS patterns, row_number() OVER (PARTITION BY chat_id ORDER BY ts, id) AS rn FROM low)
"""
PAIRS = NODES + """, cand AS (SELECT b.chat_id, a.id AS src, b.id AS dst, abs(epoch_us(b.ts) - epoch_us(a.ts)) / 60000000::DOUBLE AS gap,
   a.words AS aw, b.words AS bw, a.patterns AS ap, b.patterns AS bp, a.low AS al, b.low AS bl,
   lower(a.sender_name) AS an, lower(b.sender_name) AS bn, a.intention AS ai, b.intention AS bi, b.reply_id AS reply_id
   FROM nodes b JOIN nodes a ON a.chat_id = b.chat_id AND a.rn BETWEEN b.rn - 10 AND b.rn - 1)
"""
FACTORS = PAIRS + """, parts AS (SELECT *, len(list_intersect(aw, bw)) AS wi, len(list_intersect(ap, bp)) AS pi
   FROM cand WHERE reply_id IS NULL OR reply_id <> src),
sims AS (SELECT *, CASE WHEN len(aw) + len(bw) - wi = 0 THEN 0 ELSE wi / (len(aw) + len(bw) - wi)::DOUBLE END AS lex,
   CASE WHEN len(ap) + len(bp) - pi = 0 THEN 0 ELSE pi / (len(ap) + len(bp) - pi)::DOUBLE END AS pat FROM parts),
factors AS (SELECT chat_id, src, dst, lex, pat,
   CAST(CASE WHEN gap <= 2 THEN 1.0 WHEN gap <= 5 THEN 0.7 WHEN gap <= 10 THEN 0.4 WHEN gap <= 30 THEN 0.2 ELSE 0.1 END AS DOUBLE) AS temporal,
   CASE WHEN len(aw) = 0 OR len(bw) = 0 THEN 0::DOUBLE ELSE least(1::DOUBLE, lex + pat * 0.3::DOUBLE) END AS semantic,
   CAST(CASE WHEN an <> '' AND contains(bl, an) THEN 0.8 WHEN bn <> '' AND contains(al, bn) THEN 0.6 WHEN an = bn THEN 0.3 ELSE 0.1 END AS DOUBLE) AS social,
   CAST(CASE WHEN ai = 'question' AND bi <> 'question' THEN 0.7 WHEN ai = 'gratitude' AND bi IN ('statement', 'information') THEN 0.5 ELSE 0.1 END AS DOUBLE) AS structural
   FROM sims),
scored AS (SELECT *, temporal * 0.4::DOUBLE + semantic * 0.3::DOUBLE + social * 0.2::DOUBLE + structural * 0.1::DOUBLE AS probability FROM factors),
explicit AS (SELECT DISTINCT c.chat_id, c.reply_id AS src, c.id AS dst FROM messages c JOIN messages p ON p.chat_id = c.chat_id AND p.id = c.reply_id),
edges AS (SELECT chat_id, src, dst, 'reply_to' AS relationship, 1::DOUBLE AS weight FROM explicit
          UNION ALL SELECT chat_id, src, dst, 'likely_reply_to', probability FROM scored WHERE probability > 0.3::DOUBLE),
users AS (SELECT chat_id, user_key, arg_min(sender_name, {'t': ts, 'i': id}) AS name, count(*) AS message_count, min(ts) AS first_seen, max(ts) AS last_seen
          FROM messages GROUP BY chat_id, user_key),
alledges AS (SELECT chat_id, 'user_' || user_key AS src, 'msg_' || id AS dst, 'sent' AS relationship, 1::DOUBLE AS weight FROM messages
          UNION ALL SELECT chat_id, 'msg_' || src, 'msg_' || dst, relationship, weight FROM edges)
"""
MEMBERS = FACTORS + """, roots AS (SELECT chat_id, id FROM messages m WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.chat_id = m.chat_id AND e.dst = m.id)),
reach AS (SELECT chat_id, id AS root_id, id AS msg_id, 0 AS level FROM roots
          UNION SELECT r.chat_id, r.root_id, e.dst, r.level + 1 FROM reach r JOIN edges e ON e.chat_id = r.chat_id AND e.src = r.msg_id),
members AS (SELECT chat_id, root_id, msg_id, min(level) AS level FROM reach GROUP BY 1, 2, 3),
sizes AS (SELECT m.chat_id, m.root_id, count(*) AS size, max(level) AS max_level, count(DISTINCT n.user_key) AS participants, min(n.ts) AS start_ts, max(n.ts) AS end_ts
          FROM members m JOIN nodes n ON n.chat_id = m.chat_id AND n.id = m.msg_id GROUP BY 1, 2),
numbered AS (SELECT r.chat_id, r.id AS root_id, row_number() OVER (PARTITION BY r.chat_id ORDER BY n.ts, r.id) AS k FROM roots r JOIN nodes n USING (chat_id, id)),
threads AS (SELECT s.*, 'thread_' || k AS thread_id FROM sizes s JOIN numbered USING (chat_id, root_id) WHERE size > 1),
rows AS (SELECT m.*, n.ts, n.user_key, n.intention, n.text FROM members m JOIN threads t USING (chat_id, root_id) JOIN nodes n ON n.chat_id = m.chat_id AND n.id = m.msg_id),
ordered AS (SELECT *, row_number() OVER (PARTITION BY chat_id, root_id ORDER BY level, ts, msg_id) AS pos FROM rows),
seqs AS (SELECT chat_id, root_id, string_agg(intention, ' → ' ORDER BY pos) FILTER (pos <= 3) AS pattern FROM ordered GROUP BY 1, 2)
"""


def us(c):
    return F.unix_micros(c).alias(c)


@query("g01_user_nodes", FACTORS + """SELECT chat_id, 'user_' || user_key AS node_id, name, message_count, epoch_us(first_seen) AS first_seen, epoch_us(last_seen) AS last_seen FROM users""")
def g01(spark, d):
    return G.user_nodes(messages(spark, d)).select("chat_id", "node_id", "name", "message_count", us("first_seen"), us("last_seen"))


@query("g02_message_nodes", NODES + """SELECT chat_id, 'msg_' || id AS node_id, intention, false AS has_media, len(words) AS words, len(patterns) AS patterns,
  trim(regexp_replace(text, '[^\\p{L}\\p{N}_\\p{M}\\s.,!?¿¡]', '', 'g')) AS clean_text FROM nodes""")
def g02(spark, d):
    return nodes(spark, d).select("chat_id", "node_id", "intention", "has_media", F.size("words").cast("long").alias("words"),
                                  F.size("patterns").cast("long").alias("patterns"), "clean_text")


@query("g03_sent_edges", FACTORS + "SELECT chat_id, src, dst, weight FROM alledges WHERE relationship = 'sent'")
def g03(spark, d):
    return G.sent_edges(messages(spark, d)).select("chat_id", "src", "dst", "weight")


@query("g04_explicit_edges", FACTORS + "SELECT chat_id, src, dst, weight FROM edges WHERE relationship = 'reply_to'")
def g04(spark, d):
    return G.explicit_edges(messages(spark, d)).select("chat_id", "src", "dst", "weight")


@query("g05_candidate_pairs", PAIRS + "SELECT chat_id, src, dst FROM cand")
def g05(spark, d):
    return G.candidate_pairs(messages(spark, d)).select("chat_id", F.col("a_id").alias("src"), F.col("b_id").alias("dst"))


@query("g06_unlinked_pairs", FACTORS + "SELECT chat_id, src, dst FROM factors")
def g06(spark, d):
    return G.unlinked_pairs(G.candidate_pairs(messages(spark, d))).select("chat_id", F.col("a_id").alias("src"), F.col("b_id").alias("dst"))


@query("g07_reply_probability", FACTORS + "SELECT chat_id, src, dst, round(weight, 6) AS probability FROM edges WHERE relationship = 'likely_reply_to'")
def g07(spark, d):
    return G.likely_edges(nodes(spark, d)).select("chat_id", "src", "dst", F.round("weight", 6).alias("probability"))


for _n, _name in [("08", "temporal"), ("09", "semantic"), ("11", "social"), ("12", "structural")]:

    def _factor(spark, d, name=_name):
        return G.reply_factors(nodes(spark, d)).select("chat_id", "src", "dst", F.round(name, 6).alias("factor"))

    query(f"g{_n}_{_name}_factor", FACTORS + f"SELECT chat_id, src, dst, round({_name}, 6) AS factor FROM factors")(_factor)


@query("g10_pattern_similarity", FACTORS + "SELECT chat_id, src, dst, round(pat, 6) AS similarity FROM factors")
def g10(spark, d):
    p = G.unlinked_pairs(G.candidate_pairs(nodes(spark, d), ["patterns"]))
    return p.select("chat_id", F.col("a_id").alias("src"), F.col("b_id").alias("dst"),
                    F.round(G.pattern_similarity(F.col("a_patterns"), F.col("b_patterns")), 6).alias("similarity"))


@query("g13_intentions", f"WITH {EVENT_MESSAGES}, low AS (SELECT *, lower(text) AS low FROM messages) SELECT id, {_INTENT} AS intention FROM low")
def g13(spark, d):
    from ..functions.text import intention

    return event_messages(spark, d).select("id", intention(F.col("text")).alias("intention"))


@query("g14_root_messages", MEMBERS + "SELECT chat_id, id FROM roots")
def g14(spark, d):
    return G.roots(messages(spark, d), replies(spark, d))


@query("g15_thread_members", MEMBERS + "SELECT chat_id, root_id, msg_id, CAST(level AS BIGINT) AS level FROM members")
def g15(spark, d):
    return members(spark, d).withColumn("level", F.col("level").cast("long"))


@query("g16_threads", MEMBERS + "SELECT chat_id, thread_id, root_id, size, participants FROM threads")
def g16(spark, d):
    return thread_table(spark, d).select("chat_id", "thread_id", "root_id", "size", "participants")


@query("g17_thread_depth", MEMBERS + "SELECT chat_id, root_id, size AS depth, CAST(max_level AS BIGINT) AS max_level FROM threads")
def g17(spark, d):
    return thread_table(spark, d).select("chat_id", "root_id", F.col("size").alias("depth"), F.col("max_level").cast("long").alias("max_level"))


_COUNTS = FACTORS + """, counts AS (SELECT chat_id, 'user' AS kind, count(*) AS n FROM users GROUP BY 1 UNION ALL SELECT chat_id, 'message', count(*) FROM messages GROUP BY 1
  UNION ALL SELECT chat_id, relationship, count(*) FROM alledges GROUP BY 1, 2)
"""


def graph_parts(spark, d):
    m = messages(spark, d)
    return G.user_nodes(m), m, G.all_edges(m, replies(spark, d))


@query("g18_graph_counts", _COUNTS + "SELECT * FROM counts")
def g18(spark, d):
    return G.graph_counts(*graph_parts(spark, d))


@query("g19_density", _COUNTS + """, t AS (SELECT chat_id, CAST(sum(n) FILTER (kind IN ('user', 'message')) AS BIGINT) AS nodes,
  CAST(sum(n) FILTER (kind NOT IN ('user', 'message')) AS BIGINT) AS edges FROM counts GROUP BY 1)
SELECT chat_id, nodes, edges, round(edges / greatest(nodes * (nodes - 1), 1)::DOUBLE, 6) AS density FROM t""")
def g19(spark, d):
    return G.density(G.graph_counts(*graph_parts(spark, d))).withColumn("density", F.round("density", 6))


@query("g20_user_activity", FACTORS + """, a AS (SELECT chat_id, src, count(*) AS activity FROM alledges WHERE relationship = 'sent' GROUP BY 1, 2)
SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY chat_id ORDER BY activity DESC, src) <= 15""")
def g20(spark, d):
    return G.user_activity(graph_parts(spark, d)[2])


@query("g21_message_degree", FACTORS + """SELECT chat_id, node_id, round(sum(weight), 6) AS score FROM
 (SELECT chat_id, src AS node_id, weight FROM alledges UNION ALL SELECT chat_id, dst, weight FROM alledges) WHERE starts_with(node_id, 'msg_') GROUP BY 1, 2""")
def g21(spark, d):
    return G.message_degree(graph_parts(spark, d)[2]).withColumn("score", F.round("score", 6))


def _selection_sql(users, msgs, slots):
    return FACTORS + f""", deg AS (SELECT chat_id, node_id, sum(weight) AS score FROM (SELECT chat_id, src AS node_id, weight FROM alledges UNION ALL SELECT chat_id, dst, weight FROM alledges)
   WHERE starts_with(node_id, 'msg_') GROUP BY 1, 2),
chosen AS (SELECT chat_id, user_key, 'user_' || user_key AS node_id FROM users QUALIFY row_number() OVER (PARTITION BY chat_id ORDER BY first_seen, user_key) <= {users}),
firsts AS (SELECT m.chat_id, 'msg_' || m.id AS node_id, row_number() OVER (PARTITION BY m.chat_id ORDER BY m.ts, m.id) AS r FROM messages m JOIN chosen c USING (chat_id, user_key)),
few AS (SELECT chat_id, count(*) AS n FROM firsts GROUP BY 1), nu AS (SELECT chat_id, count(*) AS u FROM chosen GROUP BY 1),
best AS (SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY score DESC, node_id) AS r FROM deg),
extra AS (SELECT b.chat_id, b.node_id, 1000000 + b.r AS r FROM best b JOIN nu USING (chat_id) LEFT JOIN few USING (chat_id)
   WHERE coalesce(few.n, 0) < {msgs} AND b.r <= {slots} AND NOT EXISTS (SELECT 1 FROM firsts f WHERE f.chat_id = b.chat_id AND f.node_id = b.node_id)),
msgs AS (SELECT chat_id, node_id FROM (SELECT * FROM firsts UNION ALL SELECT * FROM extra) QUALIFY row_number() OVER (PARTITION BY chat_id ORDER BY r) <= {msgs}),
selection AS (SELECT chat_id, node_id, 'user' AS kind FROM chosen UNION ALL SELECT chat_id, node_id, 'message' FROM msgs)
"""


def selection(spark, d):
    return G.select_subgraph(*graph_parts(spark, d))


@query("g22_text_view_selection", _selection_sql(20, 90, "100 - u") + "SELECT * FROM selection")
def g22(spark, d):
    return selection(spark, d)


@query("g22b_reduced_selection", _selection_sql(4, 8, "8") + "SELECT * FROM selection")
def g22b(spark, d):
    return G.select_subgraph(*graph_parts(spark, d), max_users=4, max_messages=8, fill=None)


@query("g23_induced_edges", _selection_sql(4, 8, "8") + """SELECT e.chat_id, e.src, e.dst, e.relationship FROM alledges e
  JOIN selection a ON a.chat_id = e.chat_id AND a.node_id = e.src JOIN selection b ON b.chat_id = e.chat_id AND b.node_id = e.dst""")
def g23(spark, d):
    parts = graph_parts(spark, d)
    return G.induced_edges(parts[2], G.select_subgraph(*parts, max_users=4, max_messages=8, fill=None)).select("chat_id", "src", "dst", "relationship")


@query("g24_indented_listing")
def g24(spark, d):
    return G.listing(nodes(spark, d), selection(spark, d), graph_parts(spark, d)[2])


@query("g25_intention_shares", _selection_sql(20, 90, "100 - u") + """, g AS (SELECT n.chat_id, n.intention, count(*) AS n FROM nodes n
  JOIN selection s ON s.chat_id = n.chat_id AND s.node_id = 'msg_' || n.id GROUP BY 1, 2)
SELECT *, round(n * 100::DOUBLE / sum(n) OVER (PARTITION BY chat_id), 1) AS percent FROM g""")
def g25(spark, d):
    return G.intention_shares(nodes(spark, d), selection(spark, d))


@query("g26_components", FACTORS + """, und AS (SELECT chat_id, src AS u, dst AS v FROM edges UNION SELECT chat_id, dst, src FROM edges),
walk AS (SELECT chat_id, id, id AS seen FROM messages UNION SELECT w.chat_id, w.id, e.v FROM walk w JOIN und e ON e.chat_id = w.chat_id AND e.u = w.seen)
SELECT chat_id, id, min(seen) AS component FROM walk GROUP BY 1, 2""")
def g26(spark, d):
    return G.components(messages(spark, d), replies(spark, d))


@query("h01_thread_totals", MEMBERS + """SELECT count(*) AS total_threads, round(avg(size), 6) AS avg_thread_length, max(size) AS max_thread_length, min(size) AS min_thread_length FROM threads""")
def h01(spark, d):
    return H.totals(thread_table(spark, d)).withColumn("avg_thread_length", F.round("avg_thread_length", 6))


@query("h02_length_histogram", MEMBERS + "SELECT size, count(*) AS threads FROM threads GROUP BY size")
def h02(spark, d):
    return H.length_histogram(thread_table(spark, d))


@query("h03_participation", MEMBERS + """SELECT user_key, count(DISTINCT chat_id || ':' || root_id) AS threads FROM rows GROUP BY 1 ORDER BY threads DESC, user_key LIMIT 10""")
def h03(spark, d):
    return H.participation(rows(spark, d))


@query("h04_thread_starters", MEMBERS + "SELECT user_key, count(*) AS threads FROM rows WHERE level = 0 GROUP BY 1 ORDER BY threads DESC, user_key LIMIT 10")
def h04(spark, d):
    return H.starters(rows(spark, d))


@query("h05_intention_sequences", MEMBERS + "SELECT pattern, count(*) AS n FROM seqs GROUP BY 1 ORDER BY n DESC, pattern LIMIT 10")
def h05(spark, d):
    return H.intention_sequences(rows(spark, d))


@query("h06_response_gaps", MEMBERS + """SELECT * FROM (SELECT chat_id, root_id, msg_id, lag(msg_id) OVER w AS prev_id, (epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1000000::DOUBLE AS gap_seconds
 FROM rows WINDOW w AS (PARTITION BY chat_id, root_id ORDER BY level, ts, msg_id)) WHERE prev_id IS NOT NULL""")
def h06(spark, d):
    return H.response_gaps(rows(spark, d))


@query("h07_thread_spans", MEMBERS + "SELECT chat_id, root_id, epoch_us(start_ts) AS start_ts, epoch_us(end_ts) AS end_ts, CAST((epoch_us(end_ts) - epoch_us(start_ts)) // 1000000 AS BIGINT) AS duration_seconds FROM threads")
def h07(spark, d):
    return H.spans(thread_table(spark, d)).select("chat_id", "root_id", us("start_ts"), us("end_ts"), "duration_seconds")


@query("h08_time_of_day", MEMBERS + """SELECT CASE WHEN hour(start_ts) BETWEEN 6 AND 11 THEN 'morning' WHEN hour(start_ts) BETWEEN 12 AND 17 THEN 'afternoon'
  WHEN hour(start_ts) >= 18 THEN 'evening' ELSE 'night' END AS slot, count(*) AS threads FROM threads GROUP BY 1""")
def h08(spark, d):
    return H.time_of_day_counts(thread_table(spark, d))


@query("h09_thread_content", MEMBERS + "SELECT round(avg(length(text)), 6) AS avg_message_length, count(*) AS total_messages_analyzed FROM rows")
def h09(spark, d):
    return H.content(rows(spark, d)).withColumn("avg_message_length", F.round("avg_message_length", 6))


_CARDS = MEMBERS + """, cards AS (SELECT m.chat_id, count(*) AS messages, count(DISTINCT m.user_key) AS users,
  coalesce((SELECT count(*) FROM threads t WHERE t.chat_id = m.chat_id), 0) AS threads,
  coalesce((SELECT avg(size) FROM threads t WHERE t.chat_id = m.chat_id), 0) AS avg_thread_length,
  coalesce((SELECT count(DISTINCT user_key) FROM rows r WHERE r.chat_id = m.chat_id), 0) AS active_users,
  coalesce((SELECT count(DISTINCT pattern) FROM seqs q WHERE q.chat_id = m.chat_id), 0) AS patterns,
  coalesce((SELECT count(*) FROM edges e WHERE e.chat_id = m.chat_id), 0) AS reply_edges FROM messages m GROUP BY 1)
"""


def cards(spark, d):
    return H.chat_cards(messages(spark, d), thread_table(spark, d), rows(spark, d), replies(spark, d))


@query("h10_chat_cards", _CARDS + "SELECT chat_id, messages, users, threads, round(avg_thread_length, 6) AS avg_thread_length, active_users, patterns, reply_edges FROM cards")
def h10(spark, d):
    return cards(spark, d).withColumn("avg_thread_length", F.round("avg_thread_length", 6))


@query("h11_primary_user", MEMBERS + """, c AS (SELECT chat_id, root_id, user_key, count(*) AS n FROM rows GROUP BY 1, 2, 3)
SELECT chat_id, root_id, user_key AS primary_user, n FROM c QUALIFY row_number() OVER (PARTITION BY chat_id, root_id ORDER BY n DESC, user_key) = 1""")
def h11(spark, d):
    return H.primary_user(rows(spark, d))


@query("h12_chronological", MEMBERS + "SELECT chat_id, root_id, msg_id, epoch_us(ts) AS ts FROM rows WHERE length(trim(text)) > 1 ORDER BY chat_id, root_id, ts NULLS FIRST, msg_id")
def h12(spark, d):
    return H.chronological(rows(spark, d)).select("chat_id", "root_id", "msg_id", us("ts"))


@query("h13_chat_search", "SELECT c_custkey AS chat_id, c_name AS chat_name FROM customer WHERE contains(lower(c_name), '#00000001')")
def h13(spark, d):
    chats = table(spark, d, "customer").select(F.col("c_custkey").alias("chat_id"), F.col("c_name").alias("chat_name"))
    return H.search_chats(chats, "#00000001")


@query("h14_intention_bars", MEMBERS + """, g AS (SELECT intention, count(*) AS n FROM rows GROUP BY 1)
SELECT intention, n, round(n * 100::DOUBLE / (SELECT sum(n) FROM g), 1) AS percent, round(n / max(n) OVER ()::DOUBLE, 6) AS bar FROM g ORDER BY n DESC, intention LIMIT 5""")
def h14(spark, d):
    g = H.intention_distribution(rows(spark, d)).select("intention", "n", "percent")
    return H.bars(g, "n").withColumn("bar", F.round("bar", 6))


@query("h15_corpus_totals", _CARDS + """SELECT count(*) AS chats, CAST(sum(threads) AS BIGINT) AS threads, CAST(sum(messages) AS BIGINT) AS messages, CAST(sum(users) AS BIGINT) AS users_by_chat,
  CAST(sum(reply_edges) AS BIGINT) AS reply_edges, (SELECT count(DISTINCT user_key) FROM messages) AS distinct_users FROM cards""")
def h15(spark, d):
    return H.corpus_totals(cards(spark, d), messages(spark, d))


@query("p18_readable_rows", MEMBERS + "SELECT chat_id, root_id, count(*) AS n FROM rows WHERE length(trim(text)) > 1 GROUP BY 1, 2")
def p18(spark, d):
    return H.chronological(rows(spark, d)).groupBy("chat_id", "root_id").agg(F.count("*").alias("n"))
