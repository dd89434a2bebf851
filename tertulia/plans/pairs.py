"""Queries of the reply-pair dataset, models and their measures."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from ..operators import evaluation as E, pairs as P
from .graph import FACTORS, _INTENT, _PATTERNS, _STOP, stored
from .inputs import CONVERSATION_MESSAGES, conversation_messages, table, text_table
from .registry import query
from .scoring import TOKENS, sequence

_RANKED = f"""WITH {CONVERSATION_MESSAGES}, ranked AS (SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY ts, id) AS rn, count(*) OVER (PARTITION BY chat_id) AS n FROM messages)"""
_POS = "positive AS (SELECT c.chat_id, p.id AS a_id, c.id AS b_id, 1 AS label, 'positive' AS kind FROM messages c JOIN messages p ON p.chat_id = c.chat_id AND p.id = c.reply_id)"
_RND = f"""asks AS (SELECT *, {P.draw_sql(42, 'id', 'k')} % n + 1 AS want FROM (SELECT *, unnest([0, 1]) AS k FROM ranked)),
random AS (SELECT q.chat_id, t.id AS a_id, q.id AS b_id, 0 AS label, 'random' AS kind FROM asks q JOIN ranked t ON t.chat_id = q.chat_id AND t.rn = q.want WHERE t.id <> q.id)"""
_TMP = f"""prevs AS (SELECT b.chat_id, b.id AS b_id, list(a.id ORDER BY a.rn) AS o FROM ranked b JOIN ranked a ON a.chat_id = b.chat_id AND a.rn BETWEEN b.rn - 10 AND b.rn - 1
   WHERE b.reply_id IS NULL OR a.id <> b.reply_id GROUP BY 1, 2),
temporal AS (SELECT chat_id, o[{P.draw_sql(43, 'b_id')} % len(o) + 1] AS a_id, b_id, 0 AS label, 'temporal' AS kind FROM prevs)"""
PAIRS = f"""{_RANKED}, {_POS}, {_RND}, {_TMP}, ids AS (SELECT * FROM positive UNION ALL SELECT * FROM random UNION ALL SELECT * FROM temporal),
pairs AS (SELECT i.*, a.text AS a_text, b.text AS b_text, abs(epoch_us(b.ts) - epoch_us(a.ts)) / 60000000::DOUBLE AS delta, CAST(a.user_key = b.user_key AS INT) AS same
   FROM ids i JOIN messages a ON a.chat_id = i.chat_id AND a.id = i.a_id JOIN messages b ON b.chat_id = i.chat_id AND b.id = i.b_id)
"""


def messages(spark, d):
    return conversation_messages(spark, d)


def pairs(spark, d):
    return stored(spark, d, "pairs", lambda: P.build_pairs(messages(spark, d)))


def ids(df):
    return df.select("chat_id", F.col("a.id").alias("a_id"), F.col("b.id").alias("b_id"))


@query("d01_positive_pairs", PAIRS + "SELECT chat_id, a_id, b_id FROM positive")
def d01(spark, d):
    return ids(P.positive_pairs(messages(spark, d)))


@query("d02_random_negatives", PAIRS + "SELECT chat_id, a_id, b_id FROM random")
def d02(spark, d):
    return ids(P.random_negatives(messages(spark, d)))


@query("d03_temporal_negatives", PAIRS + "SELECT chat_id, a_id, b_id FROM temporal")
def d03(spark, d):
    return ids(P.temporal_negatives(messages(spark, d)))


@query("d04_time_delta", PAIRS + "SELECT chat_id, a_id, b_id, kind, round(delta, 6) AS time_delta_min FROM pairs")
def d04(spark, d):
    p = pairs(spark, d)
    return p.select("chat_id", F.col("a.id").alias("a_id"), F.col("b.id").alias("b_id"), "kind", F.round("time_delta_min", 6).alias("time_delta_min"))


@query("d05_same_author", PAIRS + "SELECT kind, CAST(same AS BIGINT) AS same_author, count(*) AS n FROM pairs GROUP BY 1, 2")
def d05(spark, d):
    return pairs(spark, d).groupBy("kind", F.col("same_author").cast("long").alias("same_author")).agg(F.count("*").alias("n"))


def vector_messages(spark, d):
    """`embeddings` as messages of ten chats; each replies to its predecessor."""
    from ..operators.ranking import lookback, time_slice

    e = table(spark, d, "embeddings").select(
        F.col("label").cast("long").alias("chat_id"), F.col("vec_id").alias("id"), (F.col("vec_id") % 7).cast("string").alias("user_key"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("vec_id") * 60).alias("ts"), F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("text"))
    prev = lookback(e, ["chat_id"], ["ts", "id"], [], 1, time_slice("ts"))
    return prev.withColumn("reply_id", F.get("prev", F.lit(0))["id"]).drop("prev")


def vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("label").cast("long").alias("chat_id"), F.col("vec_id").alias("id"), "embedding")


@query("d06_hard_negatives", """WITH m AS (SELECT CAST(label AS BIGINT) AS chat_id, vec_id AS id, CAST(embedding AS DOUBLE[]) AS e, lag(vec_id) OVER (PARTITION BY label ORDER BY vec_id) AS parent FROM embeddings),
sims AS (SELECT q.chat_id, q.id AS b_id, q.parent, t.id AS a_id, round(list_cosine_similarity(q.e, t.e), 12) AS sim FROM m q JOIN m t ON t.chat_id = q.chat_id WHERE q.parent IS NOT NULL AND q.parent > 0),
near AS (SELECT * FROM sims QUALIFY row_number() OVER (PARTITION BY chat_id, b_id ORDER BY sim DESC, a_id) <= 50)
SELECT chat_id, a_id, b_id FROM near WHERE a_id <> parent AND a_id <> b_id AND sim >= 0.35 QUALIFY row_number() OVER (PARTITION BY chat_id, b_id ORDER BY sim DESC, a_id) <= 10""")
def d06(spark, d):
    m = vector_messages(spark, d)
    return ids(P.hard_negatives(P.positive_pairs(m), m, vectors(spark, d)))


@query("d06b_nearest_in_chat", """WITH m AS (SELECT CAST(label AS BIGINT) AS chat_id, vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)
SELECT q.chat_id, q.id AS query_id, t.id AS target_id, round(list_cosine_similarity(q.e, t.e), 6) AS sim FROM m q JOIN m t ON t.chat_id = q.chat_id
QUALIFY row_number() OVER (PARTITION BY q.chat_id, q.id ORDER BY round(list_cosine_similarity(q.e, t.e), 12) DESC, t.id) <= 50""")
def d06b(spark, d):
    v = vectors(spark, d)
    n = P.nearest_in_chat(v.withColumnRenamed("id", "query_id"), v.withColumnRenamed("id", "target_id"))
    return n.select("chat_id", "query_id", "target_id", F.round("sim", 6).alias("sim"))


_W = "regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}_]+')"


@query("d07_text_embedding", f"WITH {CONVERSATION_MESSAGES} SELECT chat_id, id, CAST(len({_W.format('text')}) AS DOUBLE) AS terms FROM messages")
def d07(spark, d):
    e = P.hashed_embedding(messages(spark, d), ["chat_id", "id"])
    return e.select("chat_id", "id", F.aggregate("embedding", F.lit(0.0).cast("double"), lambda a, x: a + x).alias("terms"))


@query("d08_shuffled_pairs", PAIRS + "SELECT chat_id, a_id, b_id, kind FROM pairs")
def d08(spark, d):
    return P.shuffled(pairs(spark, d)).select("chat_id", F.col("a.id").alias("a_id"), F.col("b.id").alias("b_id"), "kind")


VOCAB = PAIRS + f""", uniq AS (SELECT DISTINCT text FROM (SELECT a_text AS text FROM pairs UNION ALL SELECT b_text FROM pairs)),
terms AS (SELECT unnest({_W.format('text')}) AS term FROM uniq), vocab AS (SELECT term, count(*) AS n FROM terms GROUP BY 1 ORDER BY n DESC, term LIMIT 8192)
"""


@query("d09_term_vocabulary", VOCAB + "SELECT term, n FROM vocab")
def d09(spark, d):
    p = pairs(spark, d)
    return P.term_vocabulary(p.select("a.text").unionByName(p.select("b.text")))


_EMO = "[\\x{1F300}-\\x{1F5FF}\\x{1F600}-\\x{1F64F}\\x{1F680}-\\x{1F6FF}\\x{1F700}-\\x{1F77F}\\x{1F780}-\\x{1F7FF}\\x{1F800}-\\x{1F8FF}\\x{1F900}-\\x{1F9FF}\\x{1FA00}-\\x{1FA6F}\\x{2702}-\\x{27B0}\\x{24C2}-\\x{1F251}]+"
# DuckDB measures edits in bytes; accented letters are first put on one-byte signs.
_ACCENTS = "áéíóúàèìòùâêîôûäëïöüñçßœæÁÉÍÓÚÀÈÌÒÙÂÊÎÔÛÄËÏÖÜÑÇ¿¡"
_SIGNS = "||".join(f"chr({i})" for i in [*range(1, 9), *range(11, 13), *range(14, 32), *[35, 36, 37, 38, 42, 43, 60, 61, 62, 64, 91, 92, 93, 94, 95, 96, 123, 124, 125, 126]][: len(_ACCENTS)])


def _bytes(c):
    return f"translate({c}, '{_ACCENTS}', {_SIGNS})"


FEATURES = VOCAB + f""", tt AS (SELECT text, list_distinct({_W.format('text')}) AS w FROM uniq),
tv AS (SELECT text, (SELECT coalesce(list(v.term), []) FROM vocab v WHERE list_contains(tt.w, v.term)) AS terms FROM tt),
tj AS (SELECT text, list(u) FILTER (u IN (SELECT term FROM vocab)) AS terms FROM (SELECT text, unnest(w) AS u FROM tt) GROUP BY 1),
feat AS (SELECT u.text, coalesce(tj.terms, []) AS terms, length(u.text) AS len, len(regexp_extract_all(u.text, '{_EMO}')) AS emojis,
  regexp_matches(u.text, '(?i)https?://\\S+|www\\.\\S+') AS url, regexp_replace(u.text, '\\P{{L}}', '', 'g') AS letters FROM uniq u LEFT JOIN tj USING (text)),
full_ AS (SELECT p.*, a.terms AS ta, b.terms AS tb, a.len AS len_a, b.len AS len_b, len(list_intersect(a.terms, b.terms)) AS i, abs(a.emojis - b.emojis) AS emoji_diff,
  a.url AND b.url AS both_url, a.letters <> '' AND a.letters = upper(a.letters) AND b.letters <> '' AND b.letters = upper(b.letters) AS both_caps,
  CASE WHEN length(a_text) = 0 OR length(b_text) = 0 THEN 0 ELSE 1 - levenshtein({_bytes('a_text')}, {_bytes('b_text')}) / greatest(length(a_text), length(b_text))::DOUBLE END AS seq
  FROM pairs p JOIN feat a ON a.text = p.a_text JOIN feat b ON b.text = p.b_text),
out AS (SELECT *, CASE WHEN len(ta) + len(tb) - i = 0 THEN 1 ELSE i / (len(ta) + len(tb) - i)::DOUBLE END AS jac FROM full_)
""".replace("""tv AS (SELECT text, (SELECT coalesce(list(v.term), []) FROM vocab v WHERE list_contains(tt.w, v.term)) AS terms FROM tt),
""", "")


def by_ids(df):
    """Pairs with the ids of their messages only: texts that no query reads again are neither joined along nor stored."""
    return df.withColumns({p: F.struct(F.col(f"{p}.id").alias("id")) for p in "ab"})


def enriched(spark, d):
    return stored(spark, d, "enriched_pairs", lambda: by_ids(P.enrich(pairs(spark, d))))


def plain_features(spark, d):
    """The pair features without edit distances."""
    return stored(spark, d, "plain_features", lambda: by_ids(P.enrich(pairs(spark, d), distance=False)))


def _feature(name, column, sql, cast=None):
    def run(spark, d):
        v = F.col("features_extra." + column)
        v = F.round(v, 6) if cast is None else v.cast(cast)
        return plain_features(spark, d).select("chat_id", F.col("a.id").alias("a_id"), F.col("b.id").alias("b_id"), "kind", v.alias("value"))

    query(name, FEATURES + f"SELECT chat_id, a_id, b_id, kind, {sql} AS value FROM out")(run)


_feature("d10_token_jaccard", "tfidf_jaccard", "round(jac, 6)")
_feature("d12_emoji_difference", "emoji_diff", "CAST(emoji_diff AS BIGINT)", "long")
_feature("d13_both_have_url", "both_have_url", "CAST(both_url AS BIGINT)", "long")
_feature("d14_both_all_caps", "both_all_caps", "CAST(both_caps AS BIGINT)", "long")


@query("d11_edit_similarity", FEATURES + "SELECT chat_id, a_id, b_id, kind, round(seq, 6) AS value FROM out")
def d11(spark, d):
    return enriched(spark, d).select("chat_id", F.col("a.id").alias("a_id"), F.col("b.id").alias("b_id"), "kind", F.round("features_extra.seq_ratio", 6).alias("value"))


@query("d15_text_lengths", FEATURES + "SELECT chat_id, a_id, b_id, kind, CAST(len_a AS BIGINT) AS len_a, CAST(len_b AS BIGINT) AS len_b FROM out")
def d15(spark, d):
    return plain_features(spark, d).select("chat_id", F.col("a.id").alias("a_id"), F.col("b.id").alias("b_id"), "kind", "features_extra.len_a", "features_extra.len_b")


@query("d16_enriched_pairs", FEATURES + """SELECT kind, count(*) AS n, round(avg(jac), 6) AS jaccard, round(avg(seq), 6) AS seq_ratio, CAST(sum(len_a + len_b) AS BIGINT) AS chars FROM out GROUP BY 1""")
def d16(spark, d):
    x = lambda c: F.col("features_extra." + c)
    return enriched(spark, d).groupBy("kind").agg(F.count("*").alias("n"), F.round(F.avg(x("tfidf_jaccard")), 6).alias("jaccard"),
                                                  F.round(F.avg(x("seq_ratio")), 6).alias("seq_ratio"), F.sum(x("len_a") + x("len_b")).alias("chars"))


STATS = PAIRS + """, stats AS (SELECT chat_id, count(*) AS total, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0 AND kind <> 'hard') AS neg,
   count(*) FILTER (kind = 'hard') AS hard FROM pairs GROUP BY ROLLUP (chat_id))
"""


@query("d17_dataset_stats", STATS + """SELECT *, round(pos / total::DOUBLE, 6) AS pos_ratio, round(neg / total::DOUBLE, 6) AS neg_ratio, round(hard / total::DOUBLE, 6) AS hard_ratio FROM stats""")
def d17(spark, d):
    s = P.dataset_stats(pairs(spark, d))
    for c in ("pos_ratio", "neg_ratio", "hard_ratio"):
        s = s.withColumn(c, F.round(c, 6))
    return s


@query("d18_hard_predicate", PAIRS + "SELECT kind, false AS hard_negative, count(*) AS n FROM pairs GROUP BY 1")
def d18(spark, d):
    p = pairs(spark, d)
    return p.groupBy("kind", P.is_hard(p).alias("hard_negative")).agg(F.count("*").alias("n"))


@query("d19_augmented_pairs")
def d19(spark, d):
    before = pairs(spark, d)
    after = P.augment(before)
    return after.groupBy("kind").agg(F.count("*").alias("n"), F.count_if(F.col("a.text").isNull()).alias("lost"), F.sum(F.length("a.text") + F.length("b.text")).alias("chars"))


_ORDER = STATS + f""", sizes AS (SELECT chat_id, total AS c, {P.draw_sql(42, 'chat_id')} AS o FROM stats WHERE chat_id IS NOT NULL)
"""


@query("d20_sampled_chats", _ORDER + """, o AS (SELECT list({'chat_id': chat_id, 'c': c} ORDER BY o, chat_id) AS s FROM sizes),
walk AS (SELECT list_reduce(list_concat([{'chat_id': -1::BIGINT, 'c': 0::BIGINT, 'ids': []::BIGINT[]}], list_transform(s, lambda x: {'chat_id': x.chat_id, 'c': x.c, 'ids': []::BIGINT[]})),
   lambda acc, x: CASE WHEN acc.c + x.c > 1000 OR acc.c >= 1000 THEN acc ELSE {'chat_id': -1::BIGINT, 'c': acc.c + x.c, 'ids': list_append(acc.ids, x.chat_id)} END) AS r FROM o)
SELECT chat_id, count(*) AS n FROM pairs WHERE list_contains((SELECT r.ids FROM walk), chat_id) GROUP BY 1""")
def d20(spark, d):
    return P.sample_chats(pairs(spark, d), 1000).groupBy("chat_id").agg(F.count("*").alias("n"))


@query("d21_holdout_chats", _ORDER + """, h AS (SELECT *, coalesce(sum(c) OVER (ORDER BY o, chat_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(c) OVER () AS t FROM sizes)
SELECT chat_id, c FROM h WHERE before < t * 0.1""")
def d21(spark, d):
    return P.holdout_chats(pairs(spark, d))


@query("d22_fold_strategy", STATS + """SELECT count(*) AS chats, round(var_pop(pos / total::DOUBLE), 8) AS pos_var, round(var_pop(hard / total::DOUBLE), 8) AS hard_var,
  CASE WHEN count(*) <= 1 THEN 'row_folds' WHEN var_pop(pos / total::DOUBLE) > 4e-4 OR var_pop(hard / total::DOUBLE) > 2e-3 THEN 'cluster_folds' ELSE 'group_folds' END AS strategy
FROM stats WHERE chat_id IS NOT NULL""")
def d22(spark, d):
    s = P.fold_strategy(P.dataset_stats(pairs(spark, d)))
    return s.withColumn("pos_var", F.round("pos_var", 8)).withColumn("hard_var", F.round("hard_var", 8))


@query("d22b_row_folds", PAIRS + f"SELECT CAST({P.draw_sql(42, 'chat_id', 'a_id', 'b_id')} % 5 AS BIGINT) AS fold, count(*) AS n FROM pairs GROUP BY 1")
def d22b(spark, d):
    return P.row_folds(pairs(spark, d)).groupBy(F.col("fold").cast("long").alias("fold")).agg(F.count("*").alias("n"))


@query("d22c_group_folds", STATS.replace("WITH", "WITH RECURSIVE", 1) + """, sizes AS (SELECT chat_id, total AS n, row_number() OVER (ORDER BY total DESC, chat_id) AS i FROM stats WHERE chat_id IS NOT NULL),
walk AS (SELECT 0::BIGINT AS i, [0, 0, 0, 0, 0]::BIGINT[] AS load, 0::BIGINT AS place, 0::BIGINT AS chat_id, 0::BIGINT AS n
  UNION ALL SELECT s.i, list_transform(w.load, lambda v, k: CASE WHEN k = list_position(w.load, list_min(w.load)) THEN v + s.n ELSE v END),
    CAST(list_position(w.load, list_min(w.load)) AS BIGINT), s.chat_id, s.n FROM walk w JOIN sizes s ON s.i = w.i + 1)
SELECT place - 1 AS fold, chat_id, n FROM walk WHERE i > 0""")
def d22c(spark, d):
    return P.group_folds(pairs(spark, d)).groupBy(F.col("fold").cast("long").alias("fold"), "chat_id").agg(F.count("*").alias("n"))


@query("d22d_cluster_folds")
def d22d(spark, d):
    p = pairs(spark, d)
    return P.cluster_folds(p, P.dataset_stats(p)).groupBy("fold", "chat_id").agg(F.count("*").alias("n"))


# `embeddings` as messages (see vector_messages), with hard negatives; an id of 0 is no reply
_HARD = (PAIRS.replace(CONVERSATION_MESSAGES, \
"""messages AS (SELECT CAST(label AS BIGINT) AS chat_id, vec_id AS id, CAST(embedding AS DOUBLE[]) AS e, CAST(vec_id % 7 AS VARCHAR) AS user_key,
   to_timestamp(1704067200 + vec_id * 60) AS ts, 'v' || vec_id AS text, lag(vec_id) OVER (PARTITION BY label ORDER BY vec_id) AS reply_id FROM embeddings)""")
    .replace("p.id = c.reply_id", "p.id = c.reply_id AND p.id <> 0")
    .replace("ids AS (", """sims AS (SELECT q.chat_id, q.id AS b_id, q.reply_id AS parent, t.id AS a_id, round(list_cosine_similarity(q.e, t.e), 12) AS sim
   FROM messages q JOIN messages t ON t.chat_id = q.chat_id WHERE q.reply_id <> 0),
near AS (SELECT * FROM sims QUALIFY row_number() OVER (PARTITION BY chat_id, b_id ORDER BY sim DESC, a_id) <= 50),
hard AS (SELECT chat_id, a_id, b_id, 0 AS label, 'hard' AS kind FROM near WHERE a_id <> parent AND a_id <> b_id AND sim >= 0.35
   QUALIFY row_number() OVER (PARTITION BY chat_id, b_id ORDER BY sim DESC, a_id) <= 10),
ids AS (SELECT * FROM hard UNION ALL """)) + STATS[len(PAIRS):]


def hard_pairs(spark, d):
    return stored(spark, d, "hard_pairs", lambda: P.build_pairs(vector_messages(spark, d), embeddings=vectors(spark, d)))


@query("d17b_stats_with_hard", _HARD + "SELECT *, round(pos / total::DOUBLE, 6) AS pos_ratio, round(neg / total::DOUBLE, 6) AS neg_ratio, round(hard / total::DOUBLE, 6) AS hard_ratio FROM stats")
def d17b(spark, d):
    s = P.dataset_stats(hard_pairs(spark, d))
    return s.withColumns({c: F.round(c, 6) for c in ("pos_ratio", "neg_ratio", "hard_ratio")})


@query("d18b_hard_rows", _HARD + "SELECT kind, kind = 'hard' AS hard_negative, count(*) AS n FROM pairs GROUP BY 1")
def d18b(spark, d):
    p = hard_pairs(spark, d)
    return p.groupBy("kind", P.is_hard(p).alias("hard_negative")).agg(F.count("*").alias("n"))


@query("d22e_strategy_with_hard", _HARD + """SELECT count(*) AS chats, round(var_pop(pos / total::DOUBLE), 8) AS pos_var, round(var_pop(hard / total::DOUBLE), 8) AS hard_var,
  CASE WHEN count(*) <= 1 THEN 'row_folds' WHEN var_pop(pos / total::DOUBLE) > 4e-4 OR var_pop(hard / total::DOUBLE) > 2e-3 THEN 'cluster_folds' ELSE 'group_folds' END AS strategy
FROM stats WHERE chat_id IS NOT NULL""")
def d22e(spark, d):
    s = P.fold_strategy(P.dataset_stats(hard_pairs(spark, d)))
    return s.withColumns({c: F.round(c, 8) for c in ("pos_var", "hard_var")})


VECTOR_ROWS = 65_536  # rows of a part of the pair vectors


def pair_vectors(spark, d):
    """All pairs, hard negatives among them, on the vectors the models are described with (4 x 256 and the pair features).

    They are stored as ML vectors without their zeros, in parts of about VECTOR_ROWS rows, at least one for each core.
    """
    def build():
        emb = P.hashed_embedding(vector_messages(spark, d), ["chat_id", "id"])
        p = hard_pairs(spark, d)
        parts = max(spark.sparkContext.defaultParallelism, -(-p.count() // VECTOR_ROWS))
        whole = P.with_vectors(by_ids(P.enrich(p)), emb)
        return E.packed(whole, 4 * 256 + 9).repartition(parts, "chat_id", "a.id", "b.id")

    return stored(spark, d, "pair_vectors", build)


@query("d23_pair_vectors", PAIRS + "SELECT chat_id, a_id, b_id, kind, 4 * 256::BIGINT + 9 AS width FROM pairs")
def d23(spark, d):
    emb = P.hashed_embedding(messages(spark, d), ["chat_id", "id"])
    return P.with_vectors(enriched(spark, d), emb).select("chat_id", F.col("a.id").alias("a_id"), F.col("b.id").alias("b_id"), "kind", F.size("vector").cast("long").alias("width"))


# hidden layers of 256 and 64, the operator's default, take 80 s a fold on 1033 features already at the smallest size
PERCEPTRON = {"hidden": (32, 16), "epochs": 5, "steps": 4}


def model_scores(spark, d, kind):
    def build():
        scored, epochs = E.cross_scores_and_epochs(P.row_folds(pair_vectors(spark, d)), kind, **(PERCEPTRON if kind == "perceptron" else {}))
        stored(spark, d, f"epochs_{kind}", lambda: epochs)
        return scored.select(F.lit(kind).alias("model"), "fold", "chat_id", F.col("a.id").alias("a_id"), F.col("b.id").alias("b_id"), "kind", "label", "score")

    return stored(spark, d, f"scores_{kind}", build)


def _model_query(name, kind):
    query(name)(lambda spark, d: E.binary_metrics(model_scores(spark, d, kind), by=["fold"]))


_model_query("e01_naive_bayes", "naive_bayes")
_model_query("e02_logistic", "logistic")
_model_query("e03_boosted_trees", "boosted")
_model_query("e04_random_forest", "forest")
_model_query("e05_perceptron", "perceptron")


@query("e05b_perceptron_epochs")
def e05b(spark, d):
    """What every epoch of every fold's perceptron measured, and whose weights were kept."""
    model_scores(spark, d, "perceptron")
    return stored(spark, d, "epochs_perceptron", lambda: E.cross_scores_and_epochs(P.row_folds(pair_vectors(spark, d)), "perceptron", **PERCEPTRON)[1])


# trained side by side, since each leaves cores idle between its passes; the forest, which takes longest, has a lane of its own
LANES = (("forest",), ("boosted", "logistic", "perceptron", "naive_bayes"))


def model_folds(spark, d):
    """Measures of every model on every fold."""
    from concurrent.futures import ThreadPoolExecutor

    from pyspark import inheritable_thread_target

    pair_vectors(spark, d)
    with ThreadPoolExecutor(len(LANES)) as side:
        lanes = [side.submit(inheritable_thread_target(spark)(lambda kinds: [model_scores(spark, d, k) for k in kinds]), kinds) for kinds in LANES]
        scores = [s for lane in lanes for s in lane.result()]
    out = scores[0]
    for s in scores[1:]:
        out = out.unionByName(s)
    return E.binary_metrics(out, by=["model", "fold"])


@query("e14b_best_fold_of_models")
def e14b(spark, d):
    return E.best_fold(model_folds(spark, d))


@query("e16b_model_table")
def e16b(spark, d):
    m = lambda c: F.avg(c).alias("mean_" + c)
    return model_folds(spark, d).groupBy("model").agg(F.count("*").alias("folds"), m("precision"), m("recall"), m("f1"), m("auc"), F.max("f1").alias("best_f1"))


@query("e06_isolation_forest")
def e06(spark, d):
    p = pair_vectors(spark, d).withColumn("pid", F.col("a.id") * 1000003 + F.col("b.id"))
    _, anomaly = E.isolation_forest(p.filter("label = 1"), F.col("pid"))
    scored = p.withColumn("anomaly", anomaly(E.as_array("features")))
    cut = E.anomaly_cut(scored.filter("label = 1"))
    flagged = scored.join(F.broadcast(cut)).withColumn("outlier", F.col("anomaly") > F.col("cut"))
    return flagged.groupBy("label", "outlier").agg(F.count("*").alias("n"))


_HEUR = PAIRS + f""", t AS (SELECT DISTINCT text, lower(text) AS low FROM (SELECT a_text AS text FROM pairs UNION ALL SELECT b_text FROM pairs)),
f AS (SELECT text, low, {_INTENT} AS intent, list_distinct(list_filter({_W.format('text')}, lambda x: x NOT IN ({_STOP}))) AS w, {_PATTERNS} AS pat FROM t),
j AS (SELECT p.*, a.w AS aw, b.w AS bw, a.pat AS ap, b.pat AS bp, a.intent AS ai, b.intent AS bi, len(list_intersect(a.w, b.w)) AS wi, len(list_intersect(a.pat, b.pat)) AS pi
  FROM pairs p JOIN f a ON a.text = p.a_text JOIN f b ON b.text = p.b_text),
s AS (SELECT *, CAST(CASE WHEN delta <= 2 THEN 1.0 WHEN delta <= 5 THEN 0.7 WHEN delta <= 10 THEN 0.4 WHEN delta <= 30 THEN 0.2 ELSE 0.1 END AS DOUBLE) * 0.4::DOUBLE
  + CASE WHEN len(aw) = 0 OR len(bw) = 0 THEN 0::DOUBLE ELSE least(1::DOUBLE, wi / (len(aw) + len(bw) - wi)::DOUBLE + CASE WHEN len(ap) + len(bp) - pi = 0 THEN 0 ELSE pi / (len(ap) + len(bp) - pi)::DOUBLE END * 0.3::DOUBLE) END * 0.3::DOUBLE
  + 0.3::DOUBLE * 0.2::DOUBLE
  + CAST(CASE WHEN ai = 'question' AND bi <> 'question' THEN 0.7 WHEN ai = 'gratitude' AND bi IN ('statement', 'information') THEN 0.5 ELSE 0.1 END AS DOUBLE) * 0.1::DOUBLE AS score FROM j)
"""


def heuristic(spark, d):
    return stored(spark, d, "heuristic_scores", lambda: by_ids(E.heuristic_scores(pairs(spark, d))))


@query("e07_heuristic_scores", _HEUR + "SELECT chat_id, a_id, b_id, kind, round(score, 6) AS score FROM s")
def e07(spark, d):
    return heuristic(spark, d).select("chat_id", F.col("a.id").alias("a_id"), F.col("b.id").alias("b_id"), "kind", F.round("score", 6).alias("score"))


_CUT = _HEUR + """, c AS (SELECT count(*) FILTER (score >= 0.5 AND label = 1) AS tp, count(*) FILTER (score >= 0.5 AND label = 0) AS fp, count(*) FILTER (score < 0.5 AND label = 1) AS fn FROM s),
pr AS (SELECT CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0 END AS recall FROM c),
rk AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM s),
au AS (SELECT (sum(r) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2.0) / (count(*) FILTER (label = 1) * count(*) FILTER (label = 0))::DOUBLE AS auc FROM rk)
"""


@query("e08_binary_metrics", _CUT + "SELECT round(precision, 6) AS precision, round(recall, 6) AS recall, round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END, 6) AS f1 FROM pr")
def e08(spark, d):
    m = E.binary_metrics(heuristic(spark, d))
    return m.select(*[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query("e09_roc_auc", _CUT + "SELECT round(auc, 6) AS auc FROM au")
def e09(spark, d):
    return E.roc_auc(heuristic(spark, d)).select(F.round("auc", 6).alias("auc"))


_REPORT = TOKENS + """, c AS (SELECT l AS label, count(*) FILTER (label = l AND prediction = l) AS tp, count(*) FILTER (label = l) AS support, count(*) FILTER (prediction = l) AS got
   FROM preds, (VALUES (0::BIGINT), (1::BIGINT)) v(l) GROUP BY l),
rep AS (SELECT label, CASE WHEN got > 0 THEN tp / got::DOUBLE ELSE 0 END AS precision, CASE WHEN support > 0 THEN tp / support::DOUBLE ELSE 0 END AS recall, support FROM c),
report AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM rep)
"""


@query("e10_overall_metrics", _REPORT + """SELECT round(sum(recall * support) / sum(support), 6) AS accuracy, round(sum(precision * support) / sum(support), 6) AS weighted_precision,
  round(sum(recall * support) / sum(support), 6) AS weighted_recall, round(sum(f1 * support) / sum(support), 6) AS weighted_f1 FROM report""")
def e10(spark, d):
    m = E.overall_metrics(sequence(spark, d), [0, 1])
    return m.select(*[F.round(c, 6).alias(c) for c in m.columns])


@query("e11_class_report", _REPORT + "SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, support, round(f1, 6) AS f1 FROM report")
def e11(spark, d):
    r = E.class_report(sequence(spark, d), [0, 1])
    return r.select("label", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"), "support", F.round("f1", 6).alias("f1"))


@query("e12_confusion_matrix", TOKENS + """SELECT a.l AS label, b.l AS prediction, (SELECT count(*) FROM preds p WHERE p.label = a.l AND p.prediction = b.l) AS n
FROM (VALUES (0::BIGINT), (1::BIGINT)) a(l), (VALUES (0::BIGINT), (1::BIGINT)) b(l)""")
def e12(spark, d):
    return E.confusion_matrix(sequence(spark, d), [0, 1])


@query("e13_error_table", TOKENS + """SELECT doc_id, CASE WHEN label = 1 AND prediction = 0 THEN 'FN' WHEN label = 0 AND prediction = 1 THEN 'FP' ELSE 'other' END AS error_type, round(abs(p1), 6) AS abs_score
FROM preds WHERE label <> prediction""")
def e13(spark, d):
    s = sequence(spark, d).withColumn("score", F.col("p1"))
    return E.error_table(s).select("doc_id", "error_type", F.round("abs_score", 6).alias("abs_score"))


_BY_CHAT = _HEUR + """, c AS (SELECT chat_id AS fold, count(*) FILTER (score >= 0.5 AND label = 1) AS tp, count(*) FILTER (score >= 0.5 AND label = 0) AS fp, count(*) FILTER (score < 0.5 AND label = 1) AS fn FROM s GROUP BY 1),
pr AS (SELECT fold, CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0 END AS r FROM c),
m AS (SELECT 'heuristic' AS model, fold, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM pr)
"""


def fold_metrics(spark, d):
    m = E.binary_metrics(heuristic(spark, d), by=["chat_id"])
    return m.select(F.lit("heuristic").alias("model"), F.col("chat_id").alias("fold"), F.round("f1", 6).alias("f1"))


@query("e14_best_fold", _BY_CHAT + "SELECT model, fold, f1 FROM m ORDER BY f1 DESC, fold LIMIT 1")
def e14(spark, d):
    return E.best_fold(fold_metrics(spark, d))


@query("e15_stratified_split", f"""SELECT doc_id, row_number() OVER (PARTITION BY quality ORDER BY {P.draw_sql(42, 'doc_id', 'quality')}, doc_id)
  <= round(count(*) OVER (PARTITION BY quality) * 0.2) AS is_test FROM labels""")
def e15(spark, d):
    return E.stratified_split(table(spark, d, "labels"), "quality", "doc_id").select("doc_id", "is_test")


@query("e16_model_summary", _BY_CHAT + "SELECT model, count(*) AS folds, round(avg(f1), 6) AS mean_f1, max(f1) AS best_f1 FROM m GROUP BY 1")
def e16(spark, d):
    return fold_metrics(spark, d).groupBy("model").agg(F.count("*").alias("folds"), F.round(F.avg("f1"), 6).alias("mean_f1"), F.max("f1").alias("best_f1"))
