"""Toxicity: the model against plain loops, interactions, held-out accuracy and awkward rows."""

import itertools
import zlib

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")

from tertulia.llm import queries, toxicity as X  # noqa: E402
from tertulia.llm.common import table  # noqa: E402


def machine(features=7, factors=3):
    m = X.FactorizationMachine(features, factors)
    r = np.random.default_rng(2)
    m.bias, m.weight, m.factor = r.normal(size=1), r.normal(size=features), r.normal(size=(features, factors))
    return m


ROWS = [[0, 3, 4], [], [6], [1, 2, 3, 5, 6]]
BAGS = (np.array([p for r in ROWS for p in r]), np.cumsum([0, *map(len, ROWS)]))


def test_logits_are_sums_over_terms_and_pairs():
    m = machine()
    want = [m.bias[0] + sum(m.weight[p] for p in r) + sum(m.factor[a] @ m.factor[b] for a, b in itertools.combinations(r, 2)) for r in ROWS]
    assert np.allclose(m.logits(*BAGS), want)


def test_gradient():
    m, y = machine(), np.array([1.0, 0, 1, 0])

    def loss():
        s = X._sigmoid(m.logits(*BAGS))
        return -(y * np.log(s) + (1 - y) * np.log(1 - s)).mean()

    got = m.gradient(*BAGS, y)
    for p, g in zip((m.bias, m.weight, m.factor), got):
        for at in np.ndindex(p.shape):
            old = p[at]
            p[at] = old + 1e-6
            up = loss()
            p[at] = old - 1e-6
            down = loss()
            p[at] = old
            assert np.isclose((up - down) / 2e-6, g[at], atol=1e-6)


def test_learns_a_pair_that_no_sum_can():
    """Label 1 where both or none of two terms are there."""
    r = np.random.default_rng(1)
    rows = [[t for t in (0, 1) if r.random() < 0.5] + [2 + int(r.integers(5))] for _ in range(400)]
    y = np.array([(0 in x) == (1 in x) for x in rows], float)
    bags = (np.array([p for x in rows for p in x]), np.cumsum([0, *map(len, rows)]))
    m = X.FactorizationMachine(7)
    m.fit(*bags, y, steps=400, decay=(0, 0))
    assert (((m.logits(*bags) > 0) == y).mean()) > 0.98


def stored(spark, tmp_path_factory, rows, schema, parts=3):
    path = str(tmp_path_factory.mktemp("table") / "t")
    spark.createDataFrame(rows, schema).repartition(parts).write.parquet(path)
    return spark.read.parquet(path)


def test_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    got = {r["doc_id"]: r for r in queries.op13_toxicity(spark, sf).collect()}
    docs = table(spark, sf, "documents")
    assert len(got) == docs.count()
    assert {d: zlib.crc32(str(d).encode()) % 5 == 0 for d in got} == {d: r["held_out"] for d, r in got.items()}
    held = [(got[r["doc_id"]], r["toxic"]) for r in table(spark, sf, "labels").collect() if got[r["doc_id"]]["held_out"]]
    assert np.mean([r["predicted"] for r, t in held if t]) > 0.85
    assert np.mean([r["predicted"] for r, t in held if not t]) < 0.01
    assert all(r["predicted"] == int(r["score"] >= 0.5) and 0 <= r["score"] <= 1 for r in got.values())


AWKWARD = [None, "", " ", "a", "Ä b\x1c c\x85d", "😀 <|endoftext|> x", "x" * 300_000, "idiot " * 3, "İSTANBUL ǅ ß", "1 2 3"]


def test_awkward_rows(spark, tmp_path_factory):
    rows = [(i, t, 5, "c", 0.5) for i, t in enumerate([*AWKWARD, *("good day number" if i % 2 else "you idiot there" for i in range(80))])] + [(12, "again", 5, "c", 0.5), (None, "no id", 1, "", 1.0)]
    docs = stored(spark, tmp_path_factory, rows, "doc_id long, text string, _id long, cell string, score double")
    labels = stored(spark, tmp_path_factory, [(i, int(i % 2 == 0), 1) for i in range(10, 90)] + [(None, 1, 1), (20, None, 1), (20, 1, 1)], "doc_id long, toxic int, score int")
    got = X.classify(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    by = {r["doc_id"]: r["predicted"] for r in got}
    assert by[7] == 1 and all(by[i] == int(i % 2 == 0) for i in range(13, 90))
    scored = X.score(docs, X.train(docs, labels))
    assert scored.columns == ["doc_id", "text", "_id", "cell", "score"] and scored.count() == len(rows)
    assert {r["score"] for r in X.classify(docs, labels.limit(0)).collect()} == {0.5}
    assert X.classify(docs.limit(0), labels).collect() == []
    ones = labels.filter("toxic = 1")
    assert len({r["score"] for r in X.classify(docs, ones).collect()}) == 1


def test_long_texts_in_stretches(monkeypatch):
    text = " ".join(f"wörd{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for i in range(3000)) + "x" * 500
    whole = X.Terms().of(text)
    monkeypatch.setattr(X, "STRETCH", 97)
    assert X.Terms().of(text) == whole and sum(n for _, n in X.words_of(text)) == 3000
    kept = np.array(whole[:50], np.int64)
    monkeypatch.setattr(X, "CACHE_ENTRIES", 20)
    terms = X.Terms(kept)
    assert terms.of(text) == terms.of(text) == list(range(50))
