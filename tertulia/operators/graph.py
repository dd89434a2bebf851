"""User/message reply graph: nodes, edges, reply probability, reachability.

Messages carry chat_id, id, sender_name, user_key, reply_id, ts, text.
Node ids are unique inside a chat; every table is keyed by chat_id first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import text as X
from ..session import KeyedTable, materialize
from .matches import match_array, prepared
from .ranking import lookback, ordered_rank, time_slice, top_k

WINDOW = 10
THRESHOLD = 0.3


def user_nodes(messages: DataFrame) -> DataFrame:
    """One row per user of a chat: name of the first message, span, number of messages."""
    extra = "sender_username" if "sender_username" in messages.columns else None
    first = F.min(F.struct("ts", "id", F.col("sender_name").alias("name"),
                           (F.col(extra) if extra else F.lit(None).cast("string")).alias("username")))
    g = messages.filter(F.col("user_key").isNotNull()).groupBy("chat_id", "user_key").agg(
        first.alias("f"), F.count("*").alias("message_count"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
    return g.select("chat_id", F.concat(F.lit("user_"), F.col("user_key")).alias("node_id"), "user_key",
                    F.coalesce("f.name", F.lit("Unknown")).alias("name"), F.coalesce("f.username", F.lit("")).alias("username"),
                    "message_count", "first_seen", "last_seen")


def message_nodes(messages: DataFrame, with_patterns: bool = True) -> DataFrame:
    """Messages with their derived attributes, computed once for every later step."""
    cols = {
        "node_id": F.concat(F.lit("msg_"), F.col("id").cast("string")),
        "clean_text": X.clean_for_analysis(F.col("text")),
        "intention": X.intention(F.col("text")),
        "has_media": F.col("media.type").isNotNull() if "media" in messages.columns else F.lit(False),
        "words": X.content_words(F.col("text")),
    }
    if with_patterns:
        cols["patterns"] = pattern_set("text")
    return prepared(messages.filter(F.col("id").isNotNull())).withColumns(cols).drop("_fold", "_digit")


def _pattern_names(h: Column) -> Column:
    """key=value; an explicit amount counts under its branch as well."""
    name = F.concat_ws("=", h["key"], h["value"])
    branch = F.concat_ws("=", F.get(h["groups"], F.lit(2)), h["value"])
    return F.when(h["key"] == "monedas_explicitas", F.array(name, branch)).otherwise(F.array(name))


def pattern_set(text: str) -> Column:
    """Distinct pattern names of a text, for the likeness of two texts."""
    return F.array_distinct(F.flatten(F.transform(match_array(text), _pattern_names)))


def sent_edges(messages: DataFrame) -> DataFrame:
    return messages.filter(F.col("user_key").isNotNull()).select(
        "chat_id", F.concat(F.lit("user_"), F.col("user_key")).alias("src"),
        F.concat(F.lit("msg_"), F.col("id").cast("string")).alias("dst"),
        F.lit("sent").alias("relationship"), F.lit(1.0).alias("weight"))


def explicit_edges(messages: DataFrame) -> DataFrame:
    """Parent to child for replies whose parent is in the chat."""
    child = messages.filter(F.col("reply_id").isNotNull() & (F.col("reply_id") != 0)).select(
        "chat_id", F.col("reply_id").alias("src"), F.col("id").alias("dst"))
    parent = messages.select("chat_id", F.col("id").alias("src"))
    return child.join(parent, ["chat_id", "src"], "left_semi").distinct().select(
        "chat_id", "src", "dst", F.lit("reply_to").alias("relationship"), F.lit(1.0).alias("weight"))


def candidate_pairs(messages: DataFrame, payload: list[str] | None = None, window: int = WINDOW) -> DataFrame:
    """Each message with its `window` predecessors in (ts, id) order of the chat.

    Columns of the predecessor get the prefix ``a_``, of the message ``b_``.
    """
    cols = [c for c in (payload if payload is not None else []) if c not in ("ts", "id")]
    base = messages.select("chat_id", "id", "ts", "reply_id", *[c for c in cols if c != "reply_id"])
    prev = lookback(base, ["chat_id"], ["ts", "id"], cols, window, time_slice("ts"))
    pairs = prev.select(
        "chat_id", F.explode("prev").alias("a"), F.col("reply_id").alias("b_reply_id"),
        *[F.col(c).alias("b_" + c) for c in dict.fromkeys(["id", "ts", *cols]) if c != "reply_id"])
    a_cols = [f.name for f in pairs.schema["a"].dataType.fields]
    return pairs.select("chat_id", *[F.col(f"a.{c}").alias("a_" + c) for c in a_cols], *[c for c in pairs.columns if c.startswith("b_")])


def unlinked_pairs(pairs: DataFrame) -> DataFrame:
    """Drop pairs already joined by an explicit reply.

    The only edge between two messages at this point is the child's own reply
    link, so a comparison does the work of an anti-join.
    """
    return pairs.filter(F.col("b_id") != F.col("a_id")).filter(
        ~F.coalesce((F.col("b_reply_id") == F.col("a_id")) & (F.col("b_reply_id") != 0), F.lit(False)))


def minutes_between(a: Column, b: Column) -> Column:
    return F.abs(F.unix_micros(b) - F.unix_micros(a)).cast("double") / F.lit(60000000.0)


def temporal_factor(a_ts: Column, b_ts: Column) -> Column:
    # Score by minutes between the messages.
    gap = minutes_between(a_ts, b_ts)
    return (F.when(gap.isNull(), 0.1).when(gap <= 2, 1.0).when(gap <= 5, 0.7).when(gap <= 10, 0.4)
            .when(gap <= 30, 0.2).otherwise(0.1))


def pattern_similarity(a: Column, b: Column) -> Column:
    return X.jaccard(a, b)


def semantic_factor(a_words: Column, b_words: Column, a_patterns: Column | None, b_patterns: Column | None) -> Column:
    lexical = X.jaccard(a_words, b_words)
    boost = pattern_similarity(a_patterns, b_patterns) * 0.3 if a_patterns is not None else F.lit(0.0)
    empty = (F.size(a_words) == 0) | (F.size(b_words) == 0)
    return F.when(empty, 0.0).otherwise(F.least(F.lit(1.0), lexical + boost))


def social_factor(a_name: Column, b_name: Column, a_low: Column, b_low: Column) -> Column:
    """A blank name mentions nobody."""
    a, b = F.coalesce(F.lower(a_name), F.lit("")), F.coalesce(F.lower(b_name), F.lit(""))
    return (F.when((a != "") & F.contains(b_low, a), 0.8).when((b != "") & F.contains(a_low, b), 0.6)
            .when(a == b, 0.3).otherwise(0.1))


def structural_factor(a_intention: Column, b_intention: Column) -> Column:
    return (F.when((a_intention == "question") & (b_intention != "question"), 0.7)
            .when((a_intention == "gratitude") & b_intention.isin("statement", "information"), 0.5).otherwise(0.1))


def reply_factors(nodes: DataFrame, window: int = WINDOW) -> DataFrame:
    """Scored candidate pairs: chat_id, src, dst and the four factors with the probability."""
    has = "patterns" in nodes.columns
    feats = nodes.withColumn("low", F.lower("text"))
    payload = ["sender_name", "low", "words", "intention"] + (["patterns"] if has else [])
    p = unlinked_pairs(candidate_pairs(feats, payload, window))
    c = F.col
    scored = p.select(
        "chat_id", c("a_id").alias("src"), c("b_id").alias("dst"),
        temporal_factor(c("a_ts"), c("b_ts")).alias("temporal"),
        semantic_factor(c("a_words"), c("b_words"), c("a_patterns") if has else None, c("b_patterns") if has else None).alias("semantic"),
        social_factor(c("a_sender_name"), c("b_sender_name"), c("a_low"), c("b_low")).alias("social"),
        structural_factor(c("a_intention"), c("b_intention")).alias("structural"))
    return scored.withColumn("probability", probability("temporal", "semantic", "social", "structural"))


def probability(temporal, semantic, social, structural) -> Column:
    # Weights of the four factors.
    col = lambda x: F.col(x) if isinstance(x, str) else x
    return (col(temporal) * F.lit(0.4) + col(semantic) * F.lit(0.3) + col(social) * F.lit(0.2) + col(structural) * F.lit(0.1))


def likely_edges(nodes: DataFrame, window: int = WINDOW, threshold: float = THRESHOLD) -> DataFrame:
    return reply_factors(nodes, window).filter(F.col("probability") > threshold).select(
        "chat_id", "src", "dst", F.lit("likely_reply_to").alias("relationship"), F.col("probability").alias("weight"))


def reply_edges(messages: DataFrame, with_patterns: bool = True) -> DataFrame:
    """Explicit and likely reply edges between message ids."""
    nodes = materialize(message_nodes(messages, with_patterns), "message_nodes")  # read twice by the lookback
    return explicit_edges(messages).unionByName(likely_edges(nodes))


def roots(messages: DataFrame, edges: DataFrame) -> DataFrame:
    return messages.select("chat_id", "id").join(
        edges.select("chat_id", F.col("dst").alias("id")), ["chat_id", "id"], "left_anti")


def shortcuts(edges: DataFrame, hops: int) -> DataFrame:
    """Shortest distances up to `hops` (a power of two) by repeated doubling."""
    s = edges.select("chat_id", "src", "dst").distinct().withColumn("d", F.lit(1))
    span = 1
    while span < hops:
        left = s.select("chat_id", "src", F.col("dst").alias("mid"), F.col("d").alias("d1"))
        right = s.select("chat_id", F.col("src").alias("mid"), "dst", F.col("d").alias("d2"))
        two = left.join(right, ["chat_id", "mid"]).select("chat_id", "src", "dst", (F.col("d1") + F.col("d2")).alias("d"))
        s = materialize(s.unionByName(two).groupBy("chat_id", "src", "dst").agg(F.min("d").alias("d")), "shortcuts")
        span *= 2
    return s


def thread_members(messages: DataFrame, edges: DataFrame, hops: int = 8) -> DataFrame:
    """Every message reachable from every root, with its breadth-first level.

    Runs until nothing new is reached; no level is cut off.  Threads never leave
    a connected component, so components of a task's work or less are dealt in
    groups and searched there, whatever their depth; only larger ones are
    searched over all tasks, in rounds of `hops` levels.
    """
    e = materialize(edges.select("chat_id", "src", "dst"), "edges")
    start = materialize(roots(messages, e).select(
        "chat_id", F.col("id").alias("root_id"), F.col("id").alias("msg_id"), F.lit(0).alias("level")), "frontier")
    small, large = by_component(e)
    found = start.unionByName(members_by_component(small).join(start.select("chat_id", "root_id").distinct(), ["chat_id", "root_id"], "left_semi"))
    if large.isEmpty():
        return found
    return found.unionByName(members_by_rounds(start, large, hops))


COMPONENT_EDGES = 200_000  # edges of a component that is searched in one task
GROUP_EDGES = 50_000  # edges of components searched together
GROUP_PAIRS = 1_000_000  # (root, message) pairs that a task may find at most, about
MOST_BATCHES = 64  # tasks among which the roots of one component are dealt


def by_component(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges of components small enough for one task, with their group, and edges of the others.

    The roots of a component with many pairs of root and message are dealt to
    batches, each of which gets all its edges; ``starts`` marks the edges whose
    source begins in the batch, if it is a root.
    """
    spark = edges.sparkSession
    e = edges.filter(F.col("chat_id").isNotNull() & (F.col("src") != F.col("dst")))
    label = component_labels(e)
    ends = e.select("chat_id", F.explode(F.array(
        F.struct(F.col("src").alias("id"), F.lit(1).alias("out")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("out")))).alias("n")
    ).groupBy("chat_id", "n.id").agg(F.sum("n.out").alias("out"), F.min("n.out").alias("only_out"))
    sizes = ends.join(label, ["chat_id", "id"]).groupBy("chat_id", "component").agg(
        F.sum("out").alias("edges"), (F.count("*") * F.sum("only_out")).alias("pairs")
    ).withColumn("batches", F.greatest(F.lit(1), F.ceil(F.col("pairs") / GROUP_PAIRS)))
    fits = (F.col("edges") <= COMPONENT_EDGES) & (F.col("batches") <= MOST_BATCHES)
    sizes = materialize(sizes.withColumn("fits", fits), "components")
    n, pairs = sizes.filter("fits").agg(F.sum("edges"), F.sum("pairs")).first()
    groups = max(spark.sparkContext.defaultParallelism, -(-(n or 0) // GROUP_EDGES), -(-(pairs or 0) // GROUP_PAIRS))
    named = e.join(label.withColumnRenamed("id", "src"), ["chat_id", "src"]).join(sizes, ["chat_id", "component"])
    named = materialize(named.select("chat_id", "src", "dst", "component", "batches", "fits"), "component_edges")
    small = named.filter("fits").withColumn("batch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("batches") - 1))).select(
        "chat_id", "src", "dst", F.pmod(F.xxhash64("chat_id", "component"), F.lit(groups)).alias("group"), "batch",
        (F.pmod(F.xxhash64("src"), F.col("batches")) == F.col("batch")).alias("starts"))
    return small, named.filter("not fits").select("chat_id", "src", "dst")


def members_by_component(edges: DataFrame) -> DataFrame:
    """What the roots of whole components reach, and their levels; each group of components is one small frame."""
    kind = {f.name: f.dataType.simpleString() for f in edges.schema.fields}
    out = f"chat_id {kind['chat_id']}, root_id {kind['src']}, msg_id {kind['dst']}, level int"

    def search(g):
        import pandas as pd

        src, dst = list(zip(g["chat_id"], g["src"])), list(zip(g["chat_id"], g["dst"]))
        after: dict = {}
        for a, b in zip(src, dst):
            after.setdefault(a, []).append(b)
        begins = {a for a, s in zip(src, g["starts"]) if s}.difference(dst)
        chats, firsts, ids, levels = [], [], [], []
        for root in begins:
            seen, frontier, level = {root}, [root], 0
            while frontier:
                level, new = level + 1, []
                for a in frontier:
                    for b in after.get(a, ()):
                        if b not in seen:
                            seen.add(b)
                            new.append(b)
                ids.extend(b[1] for b in new)
                levels.extend([level] * len(new))
                frontier = new
            chats.extend([root[0]] * (len(seen) - 1))
            firsts.extend([root[1]] * (len(seen) - 1))
        return pd.DataFrame({"chat_id": chats, "root_id": firsts, "msg_id": ids, "level": levels})

    return edges.groupBy("group", "batch").applyInPandas(search, out)


def members_by_rounds(start: DataFrame, edges: DataFrame, hops: int) -> DataFrame:
    """What the roots reach over edges of any number, and its breadth-first level.

    A round moves `hops` levels at once over precomputed shortcuts, so the
    number of rounds (and of shuffles) is the depth over `hops`: a message at
    level l has an ancestor at the last multiple of `hops`, at distance below
    `hops`, and only those ancestors form the next frontier.  The members found
    so far lie bucketed by (chat, root, message), so a round shuffles what its
    frontier reaches and nothing else.
    """
    step = shortcuts(edges, hops)
    key = ["chat_id", "root_id", "msg_id"]
    begun = start.join(edges.select("chat_id", F.col("src").alias("root_id")).distinct(), ["chat_id", "root_id"], "left_semi")
    table, frontier, base = KeyedTable(start.sparkSession, "members", key), materialize(begun.select(*key, "level"), "frontier"), 0
    table.append(frontier)
    while True:
        reached = (
            frontier.join(step, (frontier.chat_id == step.chat_id) & (frontier.msg_id == step.src))
            .select(frontier.chat_id, "root_id", F.col("dst").alias("msg_id"), (F.col("level") + F.col("d")).alias("level"))
            .groupBy(*key).agg(F.min("level").alias("level"))
        )
        new = materialize(unseen(reached, table), "reached")
        table.append(new)
        base += hops
        frontier = new.filter(F.col("level") == base)
        if frontier.isEmpty():
            return table.forget().filter(F.col("level") > 0)


def unseen(reached: DataFrame, table: KeyedTable) -> DataFrame:
    """The rows whose key the table does not hold; the table is not shuffled."""
    return reached.repartition(table.buckets, *table.key).join(table.read(), table.key, "left_anti")


def threads(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """Threads of two or more messages: number, size, true depth, users, span.

    Numbers follow the order of the root messages in the chat, single-message
    roots included.
    """
    m = members.join(nodes.select("chat_id", F.col("id").alias("msg_id"), "ts", "user_key"), ["chat_id", "msg_id"])
    per_user = m.groupBy("chat_id", "root_id", "user_key").agg(
        F.count("*").alias("c"), F.max("level").alias("lv"), F.min("ts").alias("t0"), F.max("ts").alias("t1"))
    sizes = per_user.groupBy("chat_id", "root_id").agg(
        F.sum("c").alias("size"), F.max("lv").alias("max_level"), F.count("user_key").alias("participants"),
        F.min("t0").alias("start_ts"), F.max("t1").alias("end_ts"))
    start = members.filter(F.col("level") == 0).select("chat_id", F.col("root_id").alias("id"))
    numbered = ordered_rank(
        nodes.select("chat_id", "id", "ts").join(start, ["chat_id", "id"], "left_semi"),
        ["chat_id"], ["ts", "id"], time_slice("ts"))
    ids = numbered.select("chat_id", F.col("id").alias("root_id"), F.concat(F.lit("thread_"), F.col("rn").cast("string")).alias("thread_id"))
    return sizes.filter(F.col("size") > 1).join(ids, ["chat_id", "root_id"])


def components(messages: DataFrame, edges: DataFrame) -> DataFrame:
    """Connected components: the least id of each message's component."""
    return messages.select("chat_id", "id").join(component_labels(edges), ["chat_id", "id"], "left").select(
        "chat_id", "id", F.coalesce("component", "id").alias("component"))


def component_labels(edges: DataFrame) -> DataFrame:
    """Component of every message with an edge, by alternating large-star and small-star steps.

    Rounds grow with the logarithm of the component size, and hubs are linked
    to their smallest neighbour instead of having their neighbour lists collected.
    """
    pairs = edges.select("chat_id", F.col("src").alias("u"), F.col("dst").alias("v")).filter(F.col("u") != F.col("v"))
    cur = materialize(_star_edges(pairs), "cc")
    while True:
        # large star: neighbours greater than u link to the least of u and its neighbours
        both = cur.unionByName(cur.select("chat_id", F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("chat_id", "u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter(F.col("v") > F.col("u")).join(least, ["chat_id", "u"]).select(
            "chat_id", F.col("m").alias("u"), "v")
        large = _star_edges(large)
        # small star: smaller neighbours of v, and v itself, link to the least of them
        low = large.groupBy("chat_id", "v").agg(F.min("u").alias("m"))
        small = large.join(low, ["chat_id", "v"]).select(
            "chat_id", F.explode(F.array(F.struct(F.col("m").alias("u"), F.col("v").alias("v")),
                                         F.struct(F.col("m").alias("u"), F.col("u").alias("v")))).alias("e")
        ).select("chat_id", "e.u", "e.v")
        after = materialize(_star_edges(small), "cc")
        same = after.count() == cur.count() and after.join(cur, ["chat_id", "u", "v"], "left_anti").isEmpty()
        cur = after
        if same:
            break
    label = cur.groupBy("chat_id", F.col("v").alias("id")).agg(F.min("u").alias("component"))
    return label.unionByName(label.select("chat_id", F.col("component").alias("id"), "component").distinct())


def _star_edges(e: DataFrame) -> DataFrame:
    """Edges from the smaller to the larger end, without repeats or loops."""
    return e.filter(F.col("u") != F.col("v")).select(
        "chat_id", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def all_edges(messages: DataFrame, replies: DataFrame) -> DataFrame:
    """Sent, explicit and likely edges under node names."""
    name = lambda c: F.concat(F.lit("msg_"), F.col(c).cast("string")).alias(c)
    return sent_edges(messages).unionByName(replies.select("chat_id", name("src"), name("dst"), "relationship", "weight"))


def graph_counts(users: DataFrame, messages: DataFrame, edges: DataFrame) -> DataFrame:
    kinds = edges.groupBy("chat_id", F.col("relationship").alias("kind")).agg(F.count("*").alias("n"))
    nodes = users.groupBy("chat_id").agg(F.count("*").alias("n")).select("chat_id", F.lit("user").alias("kind"), "n").unionByName(
        messages.groupBy("chat_id").agg(F.count("*").alias("n")).select("chat_id", F.lit("message").alias("kind"), "n"))
    return nodes.unionByName(kinds)


def density(counts: DataFrame) -> DataFrame:
    node = F.col("kind").isin("user", "message")
    t = counts.groupBy("chat_id").agg(F.sum(F.when(node, F.col("n")).otherwise(0)).alias("nodes"),
                                      F.sum(F.when(~node, F.col("n")).otherwise(0)).alias("edges"))
    return t.select("chat_id", "nodes", "edges", (F.col("edges") / F.greatest(F.col("nodes") * (F.col("nodes") - 1), F.lit(1))).alias("density"))


def user_activity(edges: DataFrame, top: int = 15) -> DataFrame:
    out = edges.filter(F.col("relationship") == "sent").groupBy("chat_id", "src").agg(F.count("*").alias("activity"))
    return top_k(out, ["chat_id"], [F.col("activity").desc(), "src"], top)


def message_degree(edges: DataFrame) -> DataFrame:
    """Weighted degree of messages over all edges, both ends."""
    ends = edges.select("chat_id", F.explode(F.array("src", "dst")).alias("node_id"), "weight")
    return ends.filter(F.col("node_id").startswith("msg_")).groupBy("chat_id", "node_id").agg(F.sum("weight").alias("score"))


def select_subgraph(users: DataFrame, messages: DataFrame, edges: DataFrame, max_users: int = 20,
                    max_messages: int = 90, fill: int | None = 100) -> DataFrame:
    """Node selection of the text view: the first users, their first messages,
    filled with the best connected ones when they are few.

    ``fill`` is the total number of nodes the fill list is cut to; None cuts it
    to `max_messages`.
    """
    chosen = top_k(users, ["chat_id"], ["first_seen", "user_key"], max_users).select("chat_id", "user_key", "node_id")
    theirs = messages.join(chosen.select("chat_id", "user_key"), ["chat_id", "user_key"], "left_semi").withColumn(
        "node_id", F.concat(F.lit("msg_"), F.col("id").cast("string")))
    first = top_k(theirs, ["chat_id"], ["ts", "id"], max_messages).select("chat_id", "node_id", F.lit(0).alias("src_rank"), F.struct(
        F.lit(0.0).alias("neg"), "ts", "id").alias("o"))
    have = chosen.groupBy("chat_id").agg(F.count("*").alias("n_users"))
    few = first.groupBy("chat_id").agg(F.count("*").alias("n"))
    room = have.join(few, "chat_id", "left").filter(F.coalesce("n", F.lit(0)) < max_messages).select(
        "chat_id", ((F.lit(fill) - F.col("n_users")) if fill is not None else F.lit(max_messages)).alias("slots"))
    top = fill if fill is not None else max_messages
    w = W.partitionBy("chat_id").orderBy(F.col("score").desc(), "node_id")
    best = message_degree(edges).withColumn("r", F.row_number().over(w)).filter(F.col("r") <= top)
    extra = best.join(room, "chat_id").filter(F.col("r") <= F.col("slots")).join(first, ["chat_id", "node_id"], "left_anti").select(
        "chat_id", "node_id", F.lit(1).alias("src_rank"),
        F.struct((-F.col("score")).alias("neg"), F.lit(None).cast("timestamp").alias("ts"), F.col("r").cast("long").alias("id")).alias("o"))
    msgs = top_k(first.unionByName(extra), ["chat_id"], ["src_rank", "o"], max_messages)
    return chosen.select("chat_id", "node_id", F.lit("user").alias("kind")).unionByName(
        msgs.select("chat_id", "node_id", F.lit("message").alias("kind")))


def induced_edges(edges: DataFrame, selection: DataFrame) -> DataFrame:
    """Edges with both ends selected; the selection is at most some hundred nodes per chat."""
    s = selection.select("chat_id", F.col("node_id").alias("src"))
    t = selection.select("chat_id", F.col("node_id").alias("dst"))
    return edges.join(s, ["chat_id", "src"], "left_semi").join(t, ["chat_id", "dst"], "left_semi")


def intention_shares(nodes: DataFrame, selection: DataFrame) -> DataFrame:
    picked = nodes.join(selection.filter(F.col("kind") == "message").select("chat_id", "node_id"), ["chat_id", "node_id"], "left_semi")
    g = picked.groupBy("chat_id", "intention").agg(F.count("*").alias("n"))
    return g.withColumn("percent", F.round(F.col("n") * 100.0 / F.sum("n").over(W.partitionBy("chat_id")), 1))


def listing(nodes: DataFrame, selection: DataFrame, edges: DataFrame, max_roots: int = 10) -> DataFrame:
    """Indented depth-first listing of the selected sub-graph, first roots only.

    A selection is bounded per chat (see `select_subgraph`), so one chat is one
    small frame for the traversal.
    """
    kept = selection.filter(F.col("kind") == "message").select("chat_id", "node_id")
    lines = nodes.join(kept, ["chat_id", "node_id"], "left_semi").select(
        "chat_id", "node_id", "ts", "id", "intention", X.truncate("text", 80).alias("short"))
    inner = induced_edges(edges.filter(F.col("relationship") != "sent"), kept).select("chat_id", "src", "dst")
    out = "chat_id long, conversation int, pos int, depth int, node_id string, line string"

    def walk(key, n, e):
        import pandas as pd

        n = n.sort_values(["ts", "id"])
        order = {k: i for i, k in enumerate(n["node_id"])}
        children: dict = {}
        for s, t in sorted(zip(e["src"], e["dst"]), key=lambda x: order[x[1]]):
            children.setdefault(s, []).append(t)
        targets = set(e["dst"])
        info = {r.node_id: (r.intention, r.short) for r in n.itertuples()}
        rows = []
        for i, root in enumerate([k for k in n["node_id"] if k not in targets][:max_roots]):
            seen, stack, pos = set(), [(root, 0)], 0
            while stack:
                node, depth = stack.pop()
                if node in seen:
                    continue
                seen.add(node)
                intent, short = info[node]
                rows.append((key[0], i + 1, pos, depth, node, f"{'  ' * depth}└─ {intent.upper()}: {short} [ID: {node[-6:]}]"))
                pos += 1
                stack.extend((c, depth + 1) for c in reversed(children.get(node, [])))
        return pd.DataFrame(rows, columns=["chat_id", "conversation", "pos", "depth", "node_id", "line"])

    return lines.groupBy("chat_id").cogroup(inner.groupBy("chat_id")).applyInPandas(walk, out)
