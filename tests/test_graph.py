"""Reply graph and threads against hand-worked cases and plain searches."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tertulia.operators import graph as G, threads as H

T0 = dt.datetime(2024, 1, 1, 8, tzinfo=dt.timezone.utc)
SCHEMA = "chat_id long, id long, sender_name string, user_key string, reply_id long, ts timestamp, text string"


def msg(i, minute, text, user="ana", reply=None, chat=1):
    return (chat, i, user, user, reply, T0 + dt.timedelta(minutes=minute), text)


@pytest.mark.parametrize("gap,score", [(1, 1.0), (2, 1.0), (4, 0.7), (9, 0.4), (29, 0.2), (31, 0.1), (None, 0.1)])
def test_temporal_bands(spark, gap, score):
    df = spark.createDataFrame([(T0, None if gap is None else T0 + dt.timedelta(minutes=gap))], "a timestamp, b timestamp")
    assert df.select(G.temporal_factor(F.col("a"), F.col("b"))).first()[0] == score


def factors(spark, *messages):
    nodes = G.message_nodes(spark.createDataFrame(list(messages), SCHEMA))
    return {(r.src, r.dst): r for r in G.reply_factors(nodes).collect()}


def test_factors_of_a_question_and_its_answer(spark):
    r = factors(spark, msg(1, 0, "¿precio de la laptop?", "ana"), msg(2, 1, "ana, la laptop vale 100 usd", "luis"))[1, 2]
    assert r.temporal == 1.0 and r.social == 0.8 and r.structural == 0.7
    assert 0 < r.semantic < 1


def test_thanks_then_statement(spark):
    assert factors(spark, msg(1, 0, "muchas gracias"), msg(2, 1, "nos vemos", "luis"))[1, 2].structural == 0.5


def test_blank_name_mentions_nobody(spark):
    assert factors(spark, msg(1, 0, "uno", ""), msg(2, 1, "dos", "luis"))[1, 2].social == 0.1


def test_same_author(spark):
    assert factors(spark, msg(1, 0, "uno dos"), msg(2, 1, "tres"))[1, 2].social == 0.3


def test_explicit_reply_is_not_a_candidate(spark):
    ms = [msg(1, 0, "uno"), msg(2, 1, "dos", "luis", 1), msg(3, 2, "tres", "luis", 99)]
    assert (1, 2) not in factors(spark, *ms)
    edges = G.reply_edges(spark.createDataFrame(ms, SCHEMA)).collect()
    assert {(e.src, e.dst) for e in edges if e.relationship == "reply_to"} == {(1, 2)}
    assert all(0.3 < e.weight <= 1 for e in edges)


def test_window_stops_at_the_chat(spark):
    ms = [msg(i, i, "hola") for i in range(1, 30)] + [msg(100 + i, i, "hola", chat=2) for i in range(3)]
    pairs = {(r.chat_id, r.a_id, r.b_id) for r in G.candidate_pairs(spark.createDataFrame(ms, SCHEMA)).collect()}
    assert pairs == {(1, a, b) for b in range(1, 30) for a in range(max(1, b - 10), b)} | {(2, 100, 101), (2, 100, 102), (2, 101, 102)}


def random_graph(n=120, seed=5):
    rng = random.Random(seed)
    edges = set()
    for b in range(n):
        for _ in range(rng.choice([0, 1, 1, 2])):
            if b and rng.random() < 0.9:
                edges.add((rng.randint(max(0, b - 10), b - 1), b))
    return n, edges


def reach(n, edges):
    out = {}
    kids = {}
    for a, b in edges:
        kids.setdefault(a, []).append(b)
    for r in [i for i in range(n) if i not in {b for _, b in edges}]:
        level, front = {r: 0}, [r]
        while front:
            nxt = []
            for u in front:
                for v in kids.get(u, []):
                    if v not in level:
                        level[v] = level[u] + 1
                        nxt.append(v)
            front = nxt
        out.update({(r, v): d for v, d in level.items()})
    return out


@pytest.mark.parametrize("hops", [2, 8])
def test_members_and_levels_are_breadth_first(spark, hops):
    n, edges = random_graph()
    m = spark.createDataFrame([msg(i, i, "x") for i in range(n)], SCHEMA)
    e = spark.createDataFrame([(1, a, b) for a, b in edges], "chat_id long, src long, dst long")
    got = {(r.root_id, r.msg_id): r.level for r in G.thread_members(m, e, hops).collect()}
    assert got == reach(n, edges)


def test_a_long_chain_is_not_cut(spark):
    m = spark.createDataFrame([msg(i, i, "x") for i in range(70)], SCHEMA)
    e = spark.createDataFrame([(1, i, i + 1) for i in range(69)], "chat_id long, src long, dst long")
    got = G.thread_members(m, e).agg(F.max("level"), F.count("*")).first()
    assert tuple(got) == (69, 70)


def test_components(spark):
    n, edges = random_graph(seed=9)
    m = spark.createDataFrame([msg(i, i, "x") for i in range(n)], SCHEMA)
    e = spark.createDataFrame([(1, a, b) for a, b in edges], "chat_id long, src long, dst long")
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    assert {r.id: r.component for r in G.components(m, e).collect()} == {i: find(i) for i in range(n)}


def test_diamond_counts_once_and_threads_are_numbered(spark):
    ms = [msg(1, 0, "a"), msg(2, 100, "b"), msg(3, 200, "c"), msg(4, 300, "d"), msg(9, 900, "solo")]
    m = spark.createDataFrame(ms, SCHEMA)
    e = spark.createDataFrame([(1, 1, 2), (1, 1, 3), (1, 2, 4), (1, 3, 4)], "chat_id long, src long, dst long")
    members = G.thread_members(m, e)
    t = G.threads(members, m).collect()
    assert [(r.thread_id, r["size"], r.max_level) for r in t] == [("thread_1", 4, 2)]
    gaps = H.response_gaps(H.thread_rows(members, m, "ts")).collect()
    assert sorted(r.gap_seconds for r in gaps) == [6000.0, 6000.0, 6000.0]


def test_listing_is_depth_first(spark):
    ms = [msg(1, 0, "uno"), msg(2, 1, "dos"), msg(3, 2, "tres")]
    nodes = G.message_nodes(spark.createDataFrame(ms, SCHEMA), with_patterns=False)
    sel = spark.createDataFrame([(1, f"msg_{i}", "message") for i in (1, 2, 3)], "chat_id long, node_id string, kind string")
    e = spark.createDataFrame([(1, "msg_1", "msg_2", "reply_to", 1.0), (1, "msg_2", "msg_3", "reply_to", 1.0)], "chat_id long, src string, dst string, relationship string, weight double")
    got = [r.line for r in G.listing(nodes, sel, e).orderBy("conversation", "pos").collect()]
    assert got == ["└─ STATEMENT: uno [ID: msg_1]", "  └─ STATEMENT: dos [ID: msg_2]", "    └─ STATEMENT: tres [ID: msg_3]"]


def test_a_round_shuffles_what_the_frontier_reaches_only(spark):
    """Members lie bucketed by their key: the scan of them feeds the join without an exchange, however many there are."""
    from tertulia.operators.graph import unseen
    from tertulia.session import KeyedTable

    key = ["chat_id", "root_id", "msg_id"]
    rows = lambda n, step=1: spark.range(0, n, step).select((F.col("id") % 3).alias("chat_id"), (F.col("id") % 11).alias("root_id"), F.col("id").alias("msg_id"), F.lit(1).alias("level"))
    table = KeyedTable(spark, "members", key)
    for _ in range(2):
        table.append(rows(0))
    table.append(rows(60_000))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        new = unseen(rows(60_040, 20), table)
        plan = new._jdf.queryExecution().executedPlan().toString()
        members = plan[plan.index("FileScan parquet"):]
        assert "Bucketed: true" in members and "SelectedBucketsCount: 4 out of 4" in members
        above = plan[:plan.index("FileScan parquet")].splitlines()
        # the exchange belongs to the reached rows, which come first
        assert plan.count("Exchange hashpartitioning") == 1 and not any("Exchange" in line for line in above[-3:])
        assert sorted(r.msg_id for r in new.collect()) == [60_000, 60_020]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    whole = table.forget()
    assert whole.count() == 60_000 and not spark.catalog.tableExists(table.name)


def plain_members(ids, edges):
    """Breadth-first levels by hand; ids that some edge leads to are no roots."""
    after = {}
    for a, b in edges:
        after.setdefault(a, set()).add(b)
    out = []
    for root in [i for i in ids if i not in {b for _, b in edges}]:
        level, at = {root: 0}, [root]
        while at:
            at = [level.setdefault(b, level[a] + 1) and b for a in at for b in sorted(after.get(a, ())) if b not in level]
        out += [(1, root, m, n) for m, n in level.items()]
    return sorted(out)


def thread_tables(spark, n, edges):
    messages = spark.createDataFrame([(1, i) for i in range(1, n + 1)], "chat_id long, id long")
    return messages, spark.createDataFrame([(1, a, b) for a, b in edges], "chat_id long, src long, dst long")


def test_a_deep_thread_takes_no_round_per_level(spark, monkeypatch):
    steps = []
    kept = G.materialize
    monkeypatch.setattr(G, "materialize", lambda df, label: steps.append(label) or kept(df, label))
    chain = [(i, i + 1) for i in range(1, 200)]
    got = sorted(map(tuple, G.thread_members(*thread_tables(spark, 203, chain)).collect()))
    assert got == sorted([(1, 1, i, i - 1) for i in range(1, 201)] + [(1, i, i, 0) for i in (201, 202, 203)])
    assert len(steps) < 200 / 8  # a round of eight levels would store a table each


@pytest.mark.parametrize("limits", [{}, {"GROUP_PAIRS": 20}, {"COMPONENT_EDGES": 12}, {"COMPONENT_EDGES": 0}])
def test_members_do_not_depend_on_how_components_are_dealt(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(G, name, value)
    rng = random.Random(7)
    edges = [(a, a + rng.randint(1, 4)) for a in range(1, 37) for _ in range(2) if a % 12]
    edges += [(20, 14), (50, 50), (50, 51), (60, 61), (61, 60), (70, 71), (70, 72)]  # back, to itself, a ring, a small thread
    got = sorted(map(tuple, G.thread_members(*thread_tables(spark, 75, edges)).collect()))
    assert got == plain_members(range(1, 76), edges)


def test_a_root_that_is_no_message_starts_no_thread(spark):
    messages, edges = thread_tables(spark, 3, [(1, 2), (9, 3)])
    doubled = messages.unionByName(messages.filter("id = 1"))
    nowhere = spark.createDataFrame([(None, 1, 3)], "chat_id long, src long, dst long")
    got = sorted(map(tuple, G.thread_members(doubled, edges.unionByName(nowhere)).collect()))
    assert got == [(1, 1, 1, 0), (1, 1, 1, 0), (1, 1, 2, 1)]
