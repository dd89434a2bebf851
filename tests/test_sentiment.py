import pytest
from pyspark.sql import functions as F

from tertulia.operators import sentiment as S


def scores(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    return {r.id: r for r in S.lexicon_scores(df, ["id"]).collect()}


def test_negation_and_intensity(spark):
    r = scores(spark, "es bueno", "no bueno", "muy bueno", "nada bueno", "la casa", "")
    assert r[0].score == 1.0 and r[1].score == -1.0 and r[2].score == 1.5
    assert r[3].score == 0.0 and r[4].score == 0.0 and r[5].score == 0.0


def test_actual_position_of_a_repeated_word(spark):
    assert scores(spark, "bueno y no bueno")[0].score == 0.0


def test_contrast_weights_the_sentence(spark):
    df = spark.createDataFrame([(1, "es bueno. pero es lento")], "id long, text string")
    got = {r.sentence_no: r.score for r in S.sentence_scores(df, ["id"]).collect()}
    assert got[0] == 1.0 and got[1] == pytest.approx(-1.2 * 1.5)


@pytest.mark.parametrize("text,delta", [
    ("deja mucho que desear", -3.0), ("el equipo no cumple", -2.0), ("me encanta", 2.5), ("superó todas las expectativas", 3.0),
    ("estoy muy contento", 2.0), ("calidad muy baja", -2.0), ("no logró nada", -4.5), ("bastante decepcionante", -2.5), ("nada bueno", -2.5),
    ("fácil de usar", 2.0), ("funciona bien", 1.5), ("recibí una excusa", -1.44), ("la mesa", 0.0)])
def test_phrase_rules(spark, text, delta):
    got = spark.createDataFrame([(text,)], "t string").select(S.phrase_adjustment(F.col("t"))).first()[0]
    assert got == pytest.approx(delta)


def test_fallback(spark):
    words = ["mejor", "amable", "gracioso", "elegante", "pintor", "casa", "PEOR"]
    got = [r[0] for r in spark.createDataFrame([(w,) for w in words], "w string").select(S.fallback_score("w")).collect()]
    assert got == [0.6, 0.3, 0.3, -0.3, -0.3, 0.0, -0.7]


def test_transitions_and_scores(spark):
    df = spark.createDataFrame([(1, ["a", "b", "a", "b"]), (0, ["a", "c", "a", "c"]), (0, ["z"])], "label long, tokens array<string>")
    t = {(r.label, r.cur, r.nxt): r.p for r in S.transitions(df).collect()}
    assert t == {(1, "a", "b"): 1.0, (1, "b", "a"): 1.0, (0, "a", "c"): 1.0, (0, "c", "a"): 1.0}
    s = S.sequence_label(S.sequence_scores(df.withColumn("id", F.monotonically_increasing_id()), S.transitions(df), ["label"])).collect()
    got = {r.label: r.prediction for r in s}
    assert got[1] == 1 and got[0] == 0


def test_summary_counts(spark):
    df = spark.createDataFrame([(1.0, "positivo"), (0.0, "neutro"), (0.0, "neutro")], "score double, label string")
    r = S.summary(df).first()
    assert (r.total_messages, r.average_score, r.neutro_pct, r.most_common_sentiment) == (3, 0.33, 66.67, "neutro")


def test_word_lookup_gives_zeros(spark):
    v = spark.createDataFrame([("a", [1.0, 2.0])], "word string, vector array<float>")
    got = {r.word: r.vector for r in S.lookup_vectors(spark.createDataFrame([("a",), ("b",)], "word string"), v, 2).collect()}
    assert got == {"a": [1.0, 2.0], "b": [0.0, 0.0]}


def test_words_keep_their_values():
    from tertulia.rules import lexicon as L

    some = {"diversidad": 1.2, "épico": 1.8, "responder": 0.5, "fallo": -1.1, "nuevo": -0.5, "pésimo": -1.5, "horrible": -1.6}
    assert {w: L.LEXICON[w] for w in some} == some
    assert min(L.POSITIVE_WORDS.values()) > 0 > max(L.NEGATIVE_WORDS.values())


def test_word_vectors_are_trained_in_parts_and_stay_in_tables(spark, monkeypatch):
    """Words of one topic end up alike; rare words and null texts have no vector; the vectors are no table of the driver."""
    import random

    import numpy as np

    r = random.Random(3)
    topics = [[f"{t}{i}" for i in range(6)] for t in "ab"]
    rows = [(i, [r.choice(topics[i % 2]) for _ in range(20)]) for i in range(300)] + [(900, ["once", "a0"]), (901, None), (902, [])]
    df = spark.createDataFrame(rows, "id long, tokens array<string>")
    monkeypatch.setattr(S, "WORDS_PER_PART", 1500)
    for iterations in (1, 3):
        got = S.word_vectors(df, size=20, iterations=iterations)
        assert "LocalTableScan" not in got._jdf.queryExecution().executedPlan().toString()
        v = {x.word: np.array(x.vector) for x in got.collect()}
        assert set(v) == {w for t in topics for w in t} and all(len(x) == 20 and np.isfinite(x).all() for x in v.values())
    texts = [np.array([r.randrange(6) + 6 * (i % 2) for _ in range(20)]) for i in range(300)]
    vectors, out = S._start_vectors([w for t in topics for w in t], 20, 42), np.zeros((12, 20), np.float32)
    for turn in range(40):
        S._skip_grams(texts, vectors, out, 5, np.random.default_rng(turn), 0.025, 0.025)
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    alike = unit @ unit.T
    assert alike[:6, :6].mean() > alike[:6, 6:].mean() + 0.3 and alike[6:, 6:].mean() > alike[:6, 6:].mean() + 0.3


def test_vectors_of_a_word_are_summed_before_they_are_shuffled(spark, monkeypatch):
    """The averages over all parts, whatever a task can hold in sums; a word leaves a task once where all of them fit."""
    import numpy as np

    rng = np.random.default_rng(7)
    rows = [(i, [f"w{k}" for k in rng.zipf(1.5, 20) % 90]) for i in range(200)] + [(900, ["w1", "once"])]
    df = spark.createDataFrame(rows, "id long, tokens array<string>").coalesce(1)
    monkeypatch.setattr(S, "WORDS_PER_PART", 300)
    monkeypatch.setattr(S, "PARTS_PER_TASK", 1000)
    got = []
    for room in (1 << 10, 16, 1):
        monkeypatch.setattr(S, "SUMMED_WORDS", room)
        got.append({r.word: np.array(r.vector) for r in S.word_vectors(df, size=8).collect()})
    assert set(got[0]) == {w for w in {x for _, t in rows for x in t} if sum(t.count(w) for _, t in rows) > 1} and "once" not in got[0]
    assert all(set(g) == set(got[0]) and all(np.allclose(g[w], got[0][w], atol=1e-6) for w in g) for g in got)

    monkeypatch.setattr(S, "SUMMED_WORDS", 1 << 10)
    sums = S._Sums(2)
    parts = [(["a", "b"], np.ones((2, 2), np.float32)), (["b", "c"], np.ones((2, 2), np.float32))]
    out = [r for p in parts for r in sums.add(*p)] + [*sums.out()]
    assert [(b.column("word").to_pylist(), b.column("n").to_pylist()) for b in out] == [(["a", "b", "c"], [1, 2, 1])]
    assert out[0].column("numbers").to_pylist() == [[1, 1], [2, 2], [1, 1]]
