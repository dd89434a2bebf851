"""Reply-pair dataset: positives, negatives, hard negatives, features, splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import text as X
from ..functions.edits import edit_distances
from ..session import materialize
from .neighbours import nearest
from .ranking import lookback, ordered_rank, running_total, time_slice, top_k, value_bucket

_M, _M2 = 2147483647, 2147483399


def draw(seed: int, *parts) -> Column:
    """Repeatable pseudo-random number in [0, 2^31) from integer columns.

    Plain arithmetic in two prime moduli, so any engine can repeat it.
    """
    x = F.lit(seed).cast("long")
    for p in parts:
        x = (x * 48271 + F.pmod(p.cast("long"), F.lit(_M)) * 69621 + 11) % _M * 40692 % _M2
    return x


def draw_sql(seed: int, *parts: str) -> str:
    x = str(seed)
    for p in parts:
        x = f"((({x}) * 48271 + ({p}) % {_M} * 69621 + 11) % {_M} * 40692 % {_M2})"
    return x


def chance(seed: int, *parts) -> Column:
    return draw(seed, *parts) / F.lit(float(_M))


def time_delta_min(a: Column, b: Column) -> Column:
    gap = F.abs(F.unix_micros(b) - F.unix_micros(a)).cast("double") / 60000000.0
    return F.coalesce(gap, F.lit(1e6))


def same_author(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b).cast("int")


_SIDE = ["id", "text", "user_key", "ts"]


def _pair_rows(joined: DataFrame, label: int, kind: str) -> DataFrame:
    """Shape a frame with a_* and b_* columns into pair rows."""
    side = lambda p: F.struct(*[F.col(f"{p}_{c}").alias(c) for c in _SIDE])
    return joined.select(
        "chat_id", side("a").alias("a"), side("b").alias("b"), F.lit(label).alias("label"), F.lit(kind).alias("kind"),
        time_delta_min(F.col("a_ts"), F.col("b_ts")).alias("time_delta_min"),
        same_author(F.col("a_user_key"), F.col("b_user_key")).alias("same_author"))


def _prefixed(m: DataFrame, p: str, *extra) -> DataFrame:
    return m.select("chat_id", *[F.col(c).alias(f"{p}_{c}") for c in _SIDE], *extra)


def positive_pairs(messages: DataFrame) -> DataFrame:
    """Parent and child of every explicit reply inside a chat."""
    child = _prefixed(messages.filter(F.coalesce("reply_id", F.lit(0)) != 0), "b", F.col("reply_id").alias("a_id"))
    parent = _prefixed(messages, "a")
    return _pair_rows(child.join(parent, ["chat_id", "a_id"]), 1, "positive")


def random_negatives(messages: DataFrame, neg_ratio: int = 2, seed: int = 42, exclude_parent: bool = False) -> DataFrame:
    """`neg_ratio` drawn messages of the same chat per message; drawing oneself gives no pair.

    A draw names the target's position in the chat, so the partner is found by
    an equality join whose keys spread evenly even inside one huge chat.
    """
    ranked = ordered_rank(messages.select("chat_id", *_SIDE, "reply_id"), ["chat_id"], ["ts", "id"], time_slice("ts"))
    k = F.explode(F.sequence(F.lit(0), F.lit(neg_ratio - 1))).alias("k")
    asks = _prefixed(ranked, "b", F.col("reply_id").alias("b_reply_id"), "n", k).withColumn(
        "rn", draw(seed, F.col("b_id"), F.col("k")) % F.col("n") + 1)
    target = _prefixed(ranked, "a", "rn")
    hit = asks.join(target, ["chat_id", "rn"]).filter(F.col("a_id") != F.col("b_id"))
    if exclude_parent:
        hit = hit.filter(~F.coalesce(F.col("a_id") == F.col("b_reply_id"), F.lit(False)))
    return _pair_rows(hit, 0, "random")


def temporal_negatives(messages: DataFrame, max_prev: int = 10, seed: int = 43) -> DataFrame:
    """One drawn message of the last `max_prev` that is not the parent."""
    prev = lookback(messages.select("chat_id", *_SIDE, "reply_id"), ["chat_id"], ["ts", "id"], ["text", "user_key"], max_prev, time_slice("ts"))
    others = F.filter("prev", lambda x: ~F.coalesce(x["id"] == F.col("reply_id"), F.lit(False)))
    chosen = prev.withColumn("o", others).filter(F.size("o") > 0).withColumn(
        "p", F.get("o", (draw(seed, F.col("id")) % F.size("o")).cast("int")))
    j = chosen.select("chat_id", *[F.col(c).alias("b_" + c) for c in _SIDE], *[F.col("p." + c).alias("a_" + c) for c in _SIDE])
    return _pair_rows(j, 0, "temporal")


def build_pairs(messages: DataFrame, neg_ratio: int = 2, max_prev: int = 10, seed: int = 42, embeddings: DataFrame | None = None) -> DataFrame:
    """Positives with random and temporal negatives, and with hard ones where embeddings (chat_id, id, embedding) are given."""
    positives = positive_pairs(messages)
    out = positives.unionByName(random_negatives(messages, neg_ratio, seed)).unionByName(
        temporal_negatives(messages, max_prev, seed + 1))
    return out if embeddings is None else out.unionByName(hard_negatives(positives, messages, embeddings))


def hashed_embedding(messages: DataFrame, keys: list[str], size: int = 256, text: str = "text") -> DataFrame:
    """Term-hash vector of each text, as a plain array; a stand-in where no embedding column is given."""
    from pyspark.ml.feature import HashingTF
    from pyspark.ml.functions import vector_to_array

    words = messages.select(*keys, X.words(F.coalesce(F.col(text), F.lit(""))).alias("_w"))
    out = HashingTF(numFeatures=size, inputCol="_w", outputCol="_v").transform(words)
    return out.select(*keys, vector_to_array("_v", "float32").alias("embedding"))


def nearest_in_chat(queries: DataFrame, targets: DataFrame, top_k_rows: int = 50, block: int = 16384, least: float = -2.0) -> DataFrame:
    """Exact cosine top-k of every query among the targets of its chat that are at least ``least`` alike.

    queries: chat_id, query_id, embedding; targets: chat_id, target_id, embedding.
    A chat of any size is many chunks of about `block` rows (see `neighbours`).
    """
    return nearest(queries, targets, top_k_rows, block, least)


def hard_negatives(positives: DataFrame, messages: DataFrame, embeddings: DataFrame, top: int = 50, take: int = 10,
                   threshold: float = 0.35, block: int = 16384) -> DataFrame:
    """Messages most similar to each reply: the top list without the pair itself, above the threshold, first `take`.

    A reply text is looked up once however many pairs it stands in.
    """
    asked = positives.select("chat_id", F.col("b.id").alias("id")).distinct()
    q = asked.join(embeddings, ["chat_id", "id"]).select("chat_id", F.col("id").alias("query_id"), "embedding")
    # what is under the threshold is never in front of what is above it, so blocks need not hand it on
    near = nearest_in_chat(q, embeddings.select("chat_id", F.col("id").alias("target_id"), "embedding"), top, block, threshold)
    pairs = positives.select("chat_id", F.col("a.id").alias("a_id"), F.col("b.id").alias("query_id"), "b")
    cand = near.join(pairs, ["chat_id", "query_id"]).filter(
        (F.col("target_id") != F.col("a_id")) & (F.col("target_id") != F.col("query_id")) & (F.col("sim") >= threshold))
    w = W.partitionBy("chat_id", "query_id", "a_id").orderBy("place")
    kept = cand.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= take)
    a = _prefixed(messages, "a").withColumnRenamed("a_id", "target_id")
    j = kept.join(a, ["chat_id", "target_id"]).select(
        "chat_id", F.col("target_id").alias("a_id"), "a_text", "a_user_key", "a_ts", "sim",
        *[F.col("b." + c).alias("b_" + c) for c in _SIDE])
    return _pair_rows(j, 0, "hard")


def is_hard(pairs: DataFrame) -> Column:
    return F.col("kind") == "hard"


def shuffled(pairs: DataFrame, seed: int = 42) -> DataFrame:
    """Repeatable shuffle: a range sort on a hash of the pair."""
    return pairs.orderBy(F.xxhash64(F.lit(seed), "chat_id", "a.id", "b.id", "kind"), "chat_id", "a.id", "b.id", "kind")


def term_vocabulary(texts: DataFrame, size: int = 8192, text: str = "text") -> DataFrame:
    """Most frequent terms over unique texts."""
    unique = texts.select(text).distinct()
    terms = unique.select(F.explode(X.words(F.col(text))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    return terms.orderBy(F.col("n").desc(), "term").limit(size)


def text_id(text: Column) -> Column:
    """128 bits that stand for a text in joins."""
    return F.unhex(F.md5(text))


def text_features(pairs: DataFrame, vocab: DataFrame) -> DataFrame:
    """Features of each distinct text of the pairs by its id: in-vocabulary terms, length, emoji runs, link, capitals.

    The vocabulary is cut to a fixed number of terms, which bounds its broadcast.
    """
    texts = pairs.select("a.text").unionByName(pairs.select("b.text")).select(F.coalesce("text", F.lit("")).alias("text"))
    pool = texts.select(text_id(F.col("text")).alias("tid"), "text").groupBy("tid").agg(F.first("text").alias("text"))
    hit = pool.select("tid", F.explode(F.array_distinct(X.words(F.col("text")))).alias("term")).join(
        F.broadcast(vocab.select("term")), "term", "left_semi").groupBy("tid").agg(F.collect_list("term").alias("terms"))
    flat = pool.select("tid", F.length("text").cast("long").alias("len"), X.emoji_runs(F.col("text")).alias("emojis"), X.has_url(F.col("text")).alias("url"), X.all_caps(F.col("text")).alias("caps"))
    return flat.join(hit, "tid", "left").select(
        "tid", F.coalesce("terms", F.array().cast("array<string>")).alias("terms"), "len", "emojis", "url", "caps")


def edit_ratios(pairs: DataFrame) -> DataFrame:
    """seq_ratio of each distinct pair of texts (by their ids _a and _b); a pair's texts travel once, whatever the number of its rows.

    Distances of a batch are worked out together, 64 rows of their matrices in one word (see `functions.edits`).
    """
    import pyarrow as pa

    def ratios(batches):
        for batch in batches:
            x, y = ([v.decode("utf-8", "replace") for v in batch.column(c).to_pylist()] for c in ("x", "y"))
            longer = [max(len(u), len(v)) for u, v in zip(x, y)]
            seq = [1.0 - d / n if u and v else 0.0 for u, v, d, n in zip(x, y, edit_distances(x, y).tolist(), longer)]
            yield pa.RecordBatch.from_arrays([batch.column("_a"), batch.column("_b"), pa.array(seq, pa.float64())], names=["_a", "_b", "seq_ratio"])

    t = pairs.select(F.coalesce("a.text", F.lit("")).alias("x"), F.coalesce("b.text", F.lit("")).alias("y"))
    distinct = t.select(text_id(F.col("x")).alias("_a"), text_id(F.col("y")).alias("_b"), "x", "y").groupBy("_a", "_b").agg(F.first("x").alias("x"), F.first("y").alias("y"))
    return distinct.select("_a", "_b", F.col("x").cast("binary").alias("x"), F.col("y").cast("binary").alias("y")).mapInArrow(
        ratios, "_a binary, _b binary, seq_ratio double")


def enrich(pairs: DataFrame, vocab: DataFrame | None = None, distance: bool = True) -> DataFrame:
    """Attach the pair features through the pool of distinct texts, which pairs meet by 128-bit ids.

    Without ``distance`` no edit distances are worked out and seq_ratio is null.
    """
    texts = pairs.select("a.text").unionByName(pairs.select("b.text"))
    vocab = vocab if vocab is not None else term_vocabulary(texts)
    f = text_features(pairs, vocab)
    side = lambda p: f.select(F.col("tid").alias(f"_{p}"), *[F.col(c).alias(f"{p}_{c}") for c in f.columns if c != "tid"])
    of = lambda p: text_id(F.coalesce(f"{p}.text", F.lit(""))).alias(f"_{p}")
    j = pairs.withColumns({"_a": of("a"), "_b": of("b")}).join(side("a"), "_a").join(side("b"), "_b")
    j = j.join(edit_ratios(pairs), ["_a", "_b"]) if distance else j.withColumn("seq_ratio", F.lit(None).cast("double"))
    extra = F.struct(
        F.col("a_len").alias("len_a"), F.col("b_len").alias("len_b"),
        X.jaccard(F.col("a_terms"), F.col("b_terms"), 1.0).alias("tfidf_jaccard"), F.col("seq_ratio"),
        F.abs(F.col("a_emojis") - F.col("b_emojis")).cast("long").alias("emoji_diff"),
        (F.col("a_url") & F.col("b_url")).cast("int").alias("both_have_url"),
        (F.col("a_caps") & F.col("b_caps")).cast("int").alias("both_all_caps"))
    return j.select(*pairs.columns, extra.alias("features_extra"))


def dataset_stats(pairs: DataFrame) -> DataFrame:
    """Counts and shares of positive, negative and hard pairs per chat, and overall (chat_id null)."""
    pos, hard = F.col("label") == 1, F.col("kind") == "hard"
    g = pairs.rollup("chat_id").agg(
        F.count("*").alias("total"), F.count_if(pos).alias("pos"), F.count_if(~pos & ~hard).alias("neg"), F.count_if(~pos & hard).alias("hard"))
    return g.select("*", *[(F.col(c) / F.col("total")).alias(c + "_ratio") for c in ("pos", "neg", "hard")])


def augment(pairs: DataFrame, p_swap: float = 0.05, p_punct: float = 0.10, p_case: float = 0.05, seed: int = 42) -> DataFrame:
    """Light noise on the pair texts, repeatable from the pair's ids."""
    ids = [F.col("chat_id"), F.col("a.id"), F.col("b.id"), F.col("label")]
    swap = chance(seed, *ids) < p_swap
    ta, tb = F.coalesce("a.text", F.lit("")), F.coalesce("b.text", F.lit(""))
    a, b = F.when(swap, tb).otherwise(ta), F.when(swap, ta).otherwise(tb)

    def punct(s: Column, k: int) -> Column:
        at = (draw(seed + k + 1, *ids) % (F.length(s) + 1)).cast("int")
        marks = F.array(*[F.lit(m) for m in [",", ".", " ...", "!", "?", ";"]])
        mark = F.get(marks, (draw(seed + k + 2, *ids) % 6).cast("int"))
        put = F.concat(F.substring(s, F.lit(1), at), mark, F.substring(s, at + 1, F.length(s)))
        cut = F.concat(F.regexp_extract(s, r"(?s)^([^,.!?;:]*)", 1), F.regexp_extract(s, r"(?s)^[^,.!?;:]*[,.!?;:]+(.*)$", 1))
        noisy = F.when(chance(seed + k + 3, *ids) < 0.6, put).otherwise(cut)
        return F.when((s != "") & (chance(seed + k, *ids) < p_punct), noisy).otherwise(s)

    def case(s: Column, k: int) -> Column:
        toks = F.filter(F.split(s, r"\s+"), lambda t: t != "")

        def one(t, i):
            r = draw(seed + k, *ids, i) % 100
            return F.when(r < 15, F.upper(t)).when(r < 30, F.lower(t)).otherwise(t)

        return F.array_join(F.transform(toks, one), " ")

    a, b = punct(a, 10), punct(b, 20)
    noise = chance(seed + 30, *ids) < p_case
    a, b = F.when(noise, case(a, 31)).otherwise(a), F.when(noise, case(b, 32)).otherwise(b)
    return pairs.withColumn("_a", a).withColumn("_b", b).withColumn("a", F.col("a").withField("text", F.col("_a"))).withColumn(
        "b", F.col("b").withField("text", F.col("_b"))).drop("_a", "_b")


def chat_order(stats: DataFrame, seed: int) -> DataFrame:
    """Chats in a repeatable random order, one row per chat."""
    return stats.withColumn("o", draw(seed, F.col("chat_id")))


def _draw_slice() -> Column:
    """Draws in 1024 ranges."""
    return F.floor(F.col("o") / (1 << 21))


def sample_chats(pairs: DataFrame, max_rows: int, seed: int = 42) -> DataFrame:
    """Whole chats up to `max_rows` rows, in random order, skipping chats that would overflow.

    A round takes the chats that still fit, in order, up to the first that
    overflows the room left; that one is skipped, and the next round goes on
    behind it with the room that is left then.  Running sums find the place, so
    no list of chats is gathered; the driver gets one place and one sum a round.
    """
    sizes = materialize(chat_order(pairs.groupBy("chat_id").agg(F.count("*").cast("long").alias("c")), seed), "chat_sizes")
    place, room, chosen = F.struct("o", "chat_id"), max_rows, F.lit(False)
    behind = F.lit(True)
    while room > 0:
        fits = behind & (F.col("c") <= room)
        run = materialize(running_total(sizes.filter(fits), [], ["o", "chat_id"], "c", _draw_slice()), "running_sizes")
        over = F.col("before") + F.col("c") > room
        stop = run.filter(over).agg(F.min(place).alias("p")).first()["p"]
        if stop is None:
            chosen = chosen | fits
            break
        at = F.struct(F.lit(stop["o"]).alias("o"), F.lit(stop["chat_id"]).alias("chat_id"))
        chosen = chosen | (fits & (place < at))
        room -= run.filter(place < at).agg(F.coalesce(F.sum("c"), F.lit(0)).alias("c")).first()["c"]
        behind = place > at
    return pairs.join(sizes.filter(chosen).select("chat_id"), "chat_id", "left_semi")


def holdout_chats(pairs: DataFrame, share: float = 0.10, seed: int = 42) -> DataFrame:
    """Chats put aside, in random order, until at least `share` of all rows are held out."""
    sizes = materialize(chat_order(pairs.groupBy("chat_id").agg(F.count("*").alias("c")), seed), "chat_sizes")
    run = running_total(sizes, [], ["o", "chat_id"], "c", _draw_slice())
    return run.filter(F.col("before") < F.col("all") * share).select("chat_id", "c")


def split_holdout(pairs: DataFrame, share: float = 0.10, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    held = holdout_chats(pairs, share, seed)
    return pairs.join(held, "chat_id", "left_anti"), pairs.join(held, "chat_id", "left_semi")


def fold_strategy(stats: DataFrame, n_splits: int = 5) -> DataFrame:
    """Which kind of split the chat statistics call for."""
    g = stats.filter(F.col("chat_id").isNotNull()).agg(
        F.count("*").alias("chats"), F.coalesce(F.var_pop("pos_ratio"), F.lit(0.0)).alias("pos_var"),
        F.coalesce(F.var_pop("hard_ratio"), F.lit(0.0)).alias("hard_var"))
    # Variances above which chats count as unlike each other.
    mixed = (F.col("pos_var") > 4e-4) | (F.col("hard_var") > 2e-3)
    kind = F.when(F.col("chats") <= 1, "row_folds").when(mixed, "cluster_folds").otherwise("group_folds")
    return g.withColumn("strategy", kind)


def row_folds(pairs: DataFrame, n_splits: int = 5, seed: int = 42) -> DataFrame:
    return pairs.withColumn("fold", (draw(seed, F.col("chat_id"), F.col("a.id"), F.col("b.id")) % n_splits).cast("int"))


def lightest_runs(counts: dict[int, int], n_splits: int) -> list[tuple[int, int, list[int]]]:
    """Where items go that are dealt largest first, each to the lightest fold so far (the first of equals).

    ``counts`` tells how many items there are of each size.  Rows (size, first
    rank, folds): from that rank on, until the next row of the size, the k-th
    item goes to ``folds[k % len(folds)]``.  Folds that lie within one size of the
    lightest take one item each in turn until a heavier one is reached, so a
    size has few rows however many items it has.
    """
    load, out = [0] * n_splits, []
    for size in sorted(counts, reverse=True):
        rank, left = 0, counts[size]
        while left:
            order = sorted(range(n_splits), key=lambda f: (load[f], f))
            turn = [f for f in order if load[f] < load[order[0]] + size]
            rest = order[len(turn):]
            rounds = left // len(turn) if not rest else min(left // len(turn), max(1, (load[rest[0]] - load[turn[0]]) // size))
            out.append((size, rank, turn))
            taken = rounds * len(turn) if rounds else left
            for k, f in enumerate(turn):
                load[f] += size * (rounds if rounds else int(k < left))
            rank, left = rank + taken, left - taken
    return out


def group_folds(pairs: DataFrame, n_splits: int = 5) -> DataFrame:
    """Chats to folds, largest first, each to the lightest fold so far.

    The walk runs over the number of chats of each size (the driver gets one
    number per size, of which there are at most about the root of twice the
    rows); a chat finds its fold by its rank among the chats of its size.
    """
    sizes = materialize(pairs.groupBy("chat_id").agg(F.count("*").alias("c")), "chat_sizes")
    counts = {r["c"]: r["count"] for r in sizes.groupBy("c").count().toLocalIterator()}
    runs = [(c, rank, turn) for c, rank, turn in lightest_runs(counts, n_splits)]
    ranked = ordered_rank(sizes, ["c"], ["chat_id"], value_bucket("chat_id")).select("chat_id", "c", (F.col("rn") - 1).alias("_at"))
    table = pairs.sparkSession.createDataFrame(runs, "c long, _from long, _turn array<int>")
    table = table.withColumn("_to", F.lead("_from").over(W.partitionBy("c").orderBy("_from")))
    met = ranked.join(table, "c").filter((F.col("_at") >= F.col("_from")) & (F.col("_to").isNull() | (F.col("_at") < F.col("_to"))))
    folds = met.select("chat_id", F.get("_turn", F.pmod(F.col("_at") - F.col("_from"), F.size("_turn")).cast("int")).alias("fold"))
    return pairs.join(folds, "chat_id")


def cluster_folds(pairs: DataFrame, stats: DataFrame, n_splits: int = 5, seed: int = 42) -> DataFrame:
    """Chats of like ratios in one fold: k-means on (positive, negative, hard) shares."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    chats = stats.filter(F.col("chat_id").isNotNull())
    vec = VectorAssembler(inputCols=["pos_ratio", "neg_ratio", "hard_ratio"], outputCol="profile").transform(chats)
    model = KMeans(k=n_splits, seed=seed, featuresCol="profile", predictionCol="fold").fit(vec)
    return pairs.join(model.transform(vec).select("chat_id", "fold"), "chat_id")


def pair_vector(a: Column, b: Column, extras: list[Column]) -> Column:
    """[a, b, |a-b|, a*b, extras] as one array."""
    a, b = a.cast("array<double>"), b.cast("array<double>")
    return F.concat(a, b, F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.zip_with(a, b, lambda x, y: x * y),
                    F.array(*[e.cast("double") for e in extras]))


def with_vectors(pairs: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Pair vectors from message embeddings and the pair features."""
    e = lambda p: embeddings.select("chat_id", F.col("id").alias(f"_{p}id"), F.col("embedding").alias(f"_{p}e"))
    j = pairs.withColumn("_aid", F.col("a.id")).withColumn("_bid", F.col("b.id")).join(e("a"), ["chat_id", "_aid"]).join(e("b"), ["chat_id", "_bid"])
    x = lambda n: F.col("features_extra." + n)
    extras = [F.col("time_delta_min"), F.col("same_author"), x("len_a"), x("len_b"), x("tfidf_jaccard"), x("seq_ratio"),
              x("emoji_diff"), x("both_have_url"), x("both_all_caps")]
    return j.select(*pairs.columns, pair_vector(F.col("_ae"), F.col("_be"), extras).alias("vector"))


def signature(messages: DataFrame, model: str, **params) -> DataFrame:
    """One-row fingerprint of a dataset: its files, message count, model and parameters."""
    per = messages.groupBy("file").agg(F.count("*").alias("c"))
    return per.agg(F.array_sort(F.collect_list("file")).alias("files"), F.sum("c").alias("total_messages")).select(
        "files", "total_messages", F.lit(model).alias("model"),
        F.map_from_arrays(F.array(*[F.lit(k) for k in sorted(params)]), F.array(*[F.lit(str(params[k])) for k in sorted(params)])).alias("params"))


def is_current(now: DataFrame, saved: DataFrame) -> bool:
    """True when a saved fingerprint equals the present one."""
    s = lambda d: d.select(F.to_json(F.struct(*sorted(d.columns))).alias("j"))
    return not s(now).join(s(saved), "j", "left_semi").isEmpty()
