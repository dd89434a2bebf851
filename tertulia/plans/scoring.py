"""Queries of sentiment."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import STOP_WORDS
from ..operators import sentiment as S
from ..rules import lexicon as L
from .graph import stored
from .inputs import EVENT_MESSAGES, _q, event_messages, table, text_table
from .registry import query

_LEX = ", ".join(f"({_q(w)}, {s}::DOUBLE)" for w, s in L.LEXICON.items())
_MOD = ", ".join(
    f"({_q(w)}, {(-1.0 if w in L.NEGATORS else 1.0) * L.INTENSIFIERS.get(w, 1.0)}::DOUBLE)"
    for w in dict.fromkeys([*L.NEGATORS, *L.INTENSIFIERS]) if " " not in w)
BASE = f"""WITH {EVENT_MESSAGES}, lex(word, score) AS (VALUES {_LEX}), mods(before, factor) AS (VALUES {_MOD})"""
_WORDS = "regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}_]+')"


def _token_sql(source, text, keys):
    return f"""w AS (SELECT {keys}, {_WORDS.format(text)} AS w FROM {source}),
steps AS (SELECT {keys}, unnest(w) AS word, CASE WHEN i > 1 THEN w[i - 1] END AS before FROM (SELECT *, generate_subscripts(w, 1) AS i, w[generate_subscripts(w, 1)] AS word0 FROM w))"""


def tokens_sql(source, text, keys):
    return f"""ws AS (SELECT {keys}, {_WORDS.format(text)} AS w FROM {source}),
ix AS (SELECT {keys}, w, unnest(range(1, len(w) + 1)) AS i FROM ws),
val AS (SELECT ix.*, coalesce(lex.score, 0) * coalesce(mods.factor, 1) AS value, lex.score AS hit
  FROM ix LEFT JOIN lex ON lex.word = w[i] LEFT JOIN mods ON i > 1 AND mods.before = w[i - 1])"""


SCORES = BASE + ", " + tokens_sql("messages", "text", "chat_id, id") + """,
scores AS (SELECT m.chat_id, m.id, m.sender_name AS sender, coalesce(sum(value), 0) AS score, count(hit) AS hits FROM messages m LEFT JOIN val v ON v.chat_id = m.chat_id AND v.id = m.id GROUP BY 1, 2, 3),
labelled AS (SELECT *, CASE WHEN score > 0.1 THEN 'positivo' WHEN score < -0.1 THEN 'negativo' ELSE 'neutro' END AS label FROM scores)
"""


def scored(spark, d):
    return S.chat_sentiment(event_messages(spark, d))


@query("m01_lexicon_score", SCORES + "SELECT chat_id, id, round(score, 6) AS score, hits FROM scores")
def m01(spark, d):
    return S.lexicon_scores(event_messages(spark, d), ["chat_id", "id"]).select("chat_id", "id", F.round("score", 6).alias("score"), "hits")


@query("m01b_document_score", f"""WITH lex(word, score) AS (VALUES {_LEX}), mods(before, factor) AS (VALUES {_MOD}), """ + tokens_sql("documents", "text", "doc_id") + """
SELECT d.doc_id, round(coalesce(sum(value), 0), 6) AS score, count(hit) AS hits FROM documents d LEFT JOIN val USING (doc_id) GROUP BY 1""")
def m01b(spark, d):
    s = S.lexicon_scores(text_table(spark, d, "documents", "doc_id", "text"), ["doc_id"])
    return s.select("doc_id", F.round("score", 6).alias("score"), "hits")


@query("m02_labels", SCORES + "SELECT label, CASE WHEN score > 0 THEN 'positivo' WHEN score < 0 THEN 'negativo' ELSE 'neutro' END AS sign_label, count(*) AS n FROM labelled GROUP BY 1, 2")
def m02(spark, d):
    return scored(spark, d).withColumn("sign_label", S.sign_label("score")).groupBy("label", "sign_label").agg(F.count("*").alias("n"))


_ADV = "CASE " + " ".join(f"WHEN contains(lower(sentence), {_q(w)}) THEN {m}" for w, m in L.ADVERSATIVES.items()) + " ELSE 1.0 END::DOUBLE"
_SENT = """sent AS (SELECT chat_id, id, generate_subscripts(s, 1) - 1 AS sentence_no, unnest(s) AS sentence FROM (SELECT chat_id, id,
  list_filter(list_transform(regexp_split_to_array(text, '[.!?\\n]+'), lambda x: trim(x)), lambda x: x <> '') AS s FROM messages))"""
SENTENCES = BASE + ", " + _SENT + ", " + tokens_sql("sent", "sentence", "chat_id, id, sentence_no") + f""",
ss AS (SELECT s.chat_id, s.id, s.sentence_no, coalesce(sum(value), 0) * {_ADV} AS score FROM sent s LEFT JOIN val USING (chat_id, id, sentence_no) GROUP BY s.chat_id, s.id, s.sentence_no, s.sentence)
"""


@query("m03_adversative_weight", SENTENCES + f"SELECT chat_id, id, CAST(sentence_no AS BIGINT) AS sentence_no, {_ADV} AS weight FROM sent")
def m03(spark, d):
    s = S.sentence_rows(event_messages(spark, d), ["chat_id", "id"])
    return s.select("chat_id", "id", F.col("sentence_no").cast("long").alias("sentence_no"), S.adversative_weight(F.col("sentence")).alias("weight"))


@query("m04_sentence_scores", SENTENCES + "SELECT chat_id, id, CAST(sentence_no AS BIGINT) AS sentence_no, round(score, 6) AS score FROM ss")
def m04(spark, d):
    s = S.sentence_scores(event_messages(spark, d), ["chat_id", "id"])
    return s.select("chat_id", "id", F.col("sentence_no").cast("long").alias("sentence_no"), F.round("score", 6).alias("score"))


_FALL = "CASE " + " ".join(f"WHEN word = {_q(k)} THEN {v}" for k, v in L.FALLBACK_WORDS.items()) + " " + " ".join(
    f"WHEN regexp_matches(word, {_q(r)}) THEN {v}" for r, v in L.FALLBACK_SUFFIXES) + " ELSE 0 END::DOUBLE"


@query("m05_fallback_score", f"""WITH {EVENT_MESSAGES}, words AS (SELECT DISTINCT unnest({_WORDS.format('text')}) AS word FROM
 (SELECT text FROM messages UNION ALL SELECT text FROM documents)) SELECT word, {_FALL} AS score FROM words""")
def m05(spark, d):
    from ..functions.text import words

    t = event_messages(spark, d).select("text").unionByName(text_table(spark, d, "documents", "text"))
    return t.select(F.explode(words(F.col("text"))).alias("word")).distinct().select("word", S.fallback_score("word").alias("score"))


def _re2_phrase(regex):
    return regex.replace("\\w", "[\\p{L}\\p{N}_]").replace("\\W", "[^\\p{L}\\p{N}_]")


_PHRASE_SQL = " + ".join(f"len(regexp_extract_all(lower(sentence), {_q(_re2_phrase(r))})) * {d}::DOUBLE" for _, r, d in L.PHRASES)


@query("m06_phrase_rules", SENTENCES + f"SELECT chat_id, id, CAST(sentence_no AS BIGINT) AS sentence_no, round({_PHRASE_SQL}, 6) AS adjustment FROM sent")
def m06(spark, d):
    s = S.sentence_rows(event_messages(spark, d), ["chat_id", "id"])
    return s.select("chat_id", "id", F.col("sentence_no").cast("long").alias("sentence_no"),
                    F.round(S.phrase_adjustment(F.col("sentence")), 6).alias("adjustment"))


def _summary_sql(by):
    b = f"{by}, " if by else ""
    g = f" GROUP BY {by}" if by else ""
    return SCORES + f""", g AS (SELECT {b}count(*) AS total_messages, round(CAST(sum(CAST(score AS DECIMAL(18,6))) AS DOUBLE) / count(*), 2) + 0.0::DOUBLE AS average_score, count(*) FILTER (label = 'positivo') AS positivo,
 count(*) FILTER (label = 'negativo') AS negativo, count(*) FILTER (label = 'neutro') AS neutro FROM labelled{g})
SELECT *, round(positivo * 100::DOUBLE / total_messages, 2) AS positivo_pct, round(negativo * 100::DOUBLE / total_messages, 2) AS negativo_pct,
 round(neutro * 100::DOUBLE / total_messages, 2) AS neutro_pct, CASE greatest(positivo, negativo, neutro) WHEN negativo THEN 'negativo' WHEN neutro THEN 'neutro' ELSE 'positivo' END AS most_common_sentiment FROM g"""


@query("m07_sentiment_summary", _summary_sql(""))
def m07(spark, d):
    return S.summary(scored(spark, d))


@query("m08_user_summary", _summary_sql("sender"))
def m08(spark, d):
    return S.summary(scored(spark, d), ["sender"])


_STOP = ", ".join(_q(w) for w in STOP_WORDS)
TOKENS = f"""WITH toks AS (SELECT doc_id, quality AS label, list_filter(regexp_split_to_array(trim(regexp_replace(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '[0-9]+', '', 'g')), '\\s+'),
   lambda w: length(w) > 2 AND w NOT IN ({_STOP})) AS tokens FROM documents JOIN labels USING (doc_id)),
vocab AS (SELECT unnest(tokens) AS token, count(*) AS n FROM toks GROUP BY 1 HAVING count(*) >= 2),
steps AS (SELECT doc_id, label, tokens, unnest(range(1, len(tokens))) AS i FROM toks),
pairs AS (SELECT label, tokens[i] AS cur, tokens[i + 1] AS nxt, count(*) AS n FROM steps GROUP BY 1, 2, 3),
known AS (SELECT * FROM pairs WHERE cur IN (SELECT token FROM vocab) AND nxt IN (SELECT token FROM vocab)),
trans AS (SELECT label, cur, nxt, n / sum(n) OVER (PARTITION BY label, cur)::DOUBLE AS p FROM known),
wide AS (SELECT cur, nxt, coalesce(sum(p) FILTER (label = 0), 0) AS p0, coalesce(sum(p) FILTER (label = 1), 0) AS p1 FROM trans GROUP BY 1, 2),
sums AS (SELECT t.doc_id, t.label, coalesce(sum(p0), 0) AS s0, coalesce(sum(p1), 0) AS s1 FROM toks t LEFT JOIN steps s USING (doc_id) LEFT JOIN wide w ON w.cur = s.tokens[i] AND w.nxt = s.tokens[i + 1] GROUP BY 1, 2),
probs AS (SELECT doc_id, label, CASE WHEN s0 + s1 > 0 THEN s0 / (s0 + s1) ELSE 0.5 END AS p0, CASE WHEN s0 + s1 > 0 THEN s1 / (s0 + s1) ELSE 0.5 END AS p1 FROM sums),
preds AS (SELECT *, CAST(CASE WHEN p1 > p0 THEN 1 ELSE 0 END AS BIGINT) AS prediction FROM probs)
"""


def labelled_tokens(spark, d):
    docs = text_table(spark, d, "documents", "doc_id", "text")
    lab = table(spark, d, "labels").select("doc_id", F.col("quality").cast("long").alias("label"))
    return docs.join(lab, "doc_id").select("doc_id", "label", S.clean_tokens("text").alias("tokens"))


@query("m09_clean_tokens", TOKENS + "SELECT doc_id, len(tokens) AS n, array_to_string(tokens, ' ') AS tokens FROM toks")
def m09(spark, d):
    return labelled_tokens(spark, d).select("doc_id", F.size("tokens").cast("long").alias("n"), F.array_join("tokens", " ").alias("tokens"))


@query("m10_vocabulary", TOKENS + "SELECT token, n FROM vocab")
def m10(spark, d):
    return S.vocabulary(labelled_tokens(spark, d))


def word_vectors(spark, d, tokens=None):
    return stored(spark, d, "word_vectors", lambda: S.word_vectors(labelled_tokens(spark, d) if tokens is None else tokens))


@query("m11_word_vectors")
def m11(spark, d):
    return word_vectors(spark, d).select("word", F.size("vector").cast("long").alias("size"))


@query("m12_transitions", TOKENS + "SELECT CAST(label AS BIGINT) AS label, cur, nxt, round(p, 6) AS p FROM trans")
def m12(spark, d):
    return S.transitions(labelled_tokens(spark, d)).withColumn("p", F.round("p", 6))


def sequence(spark, d):
    # read three times: the texts are cleaned once
    t = stored(spark, d, "labelled_tokens", lambda: labelled_tokens(spark, d))
    return S.sequence_label(S.sequence_scores(t, S.transitions(t), ["doc_id", "label"]))


@query("m13_sequence_scores", TOKENS + "SELECT doc_id, round(p0, 6) AS p0, round(p1, 6) AS p1 FROM probs")
def m13(spark, d):
    return sequence(spark, d).select("doc_id", F.round("p0", 6).alias("p0"), F.round("p1", 6).alias("p1"))


@query("m14_sequence_labels", TOKENS + "SELECT doc_id, prediction FROM preds")
def m14(spark, d):
    return sequence(spark, d).select("doc_id", "prediction")


@query("m15_tfidf_logistic")
def m15(spark, d):
    """Predictions of the documents that the model did not learn from."""
    from ..operators.evaluation import stratified_split

    t = stratified_split(labelled_tokens(spark, d), "label", "doc_id")
    model = S.tfidf_logistic(t.filter(~F.col("is_test")))
    return model.transform(t.filter("is_test")).select("doc_id", "label", F.col("prediction").cast("long").alias("prediction"))


@query("m16_sign_values", SCORES + """SELECT chat_id, id, CAST(sign(score) AS BIGINT) AS three_way, CAST(CASE WHEN score > 0 THEN 1 ELSE 0 END AS BIGINT) AS two_way FROM scores""")
def m16(spark, d):
    return S.lexicon_scores(event_messages(spark, d), ["chat_id", "id"]).select(
        "chat_id", "id", S.sign_value("score").alias("three_way"), S.sign_value("score", neutral=False).alias("two_way"))


POLARITY = f"""WITH {EVENT_MESSAGES}, lex(word, score) AS (VALUES {_LEX}), ws AS (SELECT m.id, CASE WHEN e.value > 20 THEN 1 ELSE 0 END AS label, {_WORDS.format('m.text')} AS w
   FROM messages m JOIN events e ON e.event_id = m.id),
p AS (SELECT DISTINCT id, label, w[i] AS cur, w[i + 1] AS nxt FROM (SELECT *, unnest(range(1, len(w))) AS i FROM ws)),
pat AS (SELECT id, label, cur || ' ' || nxt AS pattern FROM p WHERE cur IN (SELECT word FROM lex) OR nxt IN (SELECT word FROM lex)),
pol AS (SELECT pattern, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label <> 1) AS neg, count(*) AS total,
   (count(*) FILTER (label = 1) - count(*) FILTER (label <> 1)) / count(*)::DOUBLE AS polarity_strength FROM pat GROUP BY 1)
"""


def polarity(spark, d):
    lab = table(spark, d, "events").select(F.col("event_id").alias("id"), F.when(F.col("value") > 20, 1).otherwise(0).alias("label"))
    m = event_messages(spark, d).select("id", "text").join(lab, "id")
    return S.pattern_polarity(S.relevant_ngrams(m, ["id", "label"]))


def _polarity_out(df):
    return df.withColumn("polarity_strength", F.round("polarity_strength", 6))


_POL = "SELECT pattern, pos, neg, total, round(polarity_strength, 6) AS polarity_strength FROM pol"


@query("m17_pattern_polarity", POLARITY + _POL)
def m17(spark, d):
    return _polarity_out(polarity(spark, d))


@query("m18_top_patterns", POLARITY + _POL + " ORDER BY total DESC, pattern LIMIT 20")
def m18(spark, d):
    return _polarity_out(S.top_patterns(polarity(spark, d)))


@query("m19_useful_patterns", POLARITY + _POL + " WHERE total >= 4 AND abs(pol.polarity_strength) >= 0.4")
def m19(spark, d):
    return _polarity_out(S.useful_patterns(polarity(spark, d)))


@query("m20_relevant_ngrams", POLARITY + "SELECT id, pattern FROM pat")
def m20(spark, d):
    return S.relevant_ngrams(event_messages(spark, d), ["id"])


@query("m21_word_lookup")
def m21(spark, d):
    # read twice: the texts are joined with their labels and cleaned once
    t = stored(spark, d, "labelled_tokens", lambda: labelled_tokens(spark, d))
    v = word_vectors(spark, d, t)
    words = t.select(F.explode("tokens").alias("word")).distinct()
    found = S.lookup_vectors(words, v)
    return found.select("word", F.exists("vector", lambda x: x != 0).alias("known"))
