import datetime as dt
import random
import re

import numpy as np
from pyspark.sql import functions as F

from tertulia.operators import evaluation as E, pairs as P

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def messages(spark, n=60, chats=3):
    rng = random.Random(1)
    rows = [(c, c * 1000 + i, f"u{rng.randint(0, 3)}", c * 1000 + i - 1 if i % 3 else None, T0 + dt.timedelta(minutes=i), f"texto {rng.randint(0, 9)} {i}")
            for c in range(chats) for i in range(1, n + 1)]
    return spark.createDataFrame(rows, "chat_id long, id long, user_key string, reply_id long, ts timestamp, text string")


def test_negatives_stay_in_the_chat_and_skip_self(spark):
    m = messages(spark)
    rows = P.build_pairs(m).collect()
    assert all(r.a.id // 1000 == r.b.id // 1000 == r.chat_id for r in rows)
    assert all(r.a.id != r.b.id for r in rows)
    tmp = [r for r in rows if r.kind == "temporal"]
    assert all(0 < r.b.id - r.a.id <= 10 for r in tmp) and len(tmp) > 150
    assert sum(r.kind == "random" for r in rows) <= 2 * 180


def test_draws_are_repeatable_and_spread(spark):
    d = spark.range(20000).select((P.draw(7, F.col("id")) % 10).alias("d")).groupBy("d").count().collect()
    assert all(1700 < r["count"] < 2300 for r in d)


def test_nearest_over_many_blocks_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(90, 8))
    x[40] = x[10]  # a tie
    chat = np.array([0] * 70 + [1] * 20)
    df = spark.createDataFrame([(int(chat[i]), i, [float(v) for v in x[i]]) for i in range(90)], "chat_id long, id long, embedding array<double>")
    got = P.nearest_in_chat(df.withColumnRenamed("id", "query_id"), df.withColumnRenamed("id", "target_id"), 5, block=16).collect()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = set()
    for i in range(90):
        cand = [(-round(float(u[i] @ u[j]), 12), j) for j in range(90) if chat[j] == chat[i]]
        want |= {(i, j) for _, j in sorted(cand)[:5]}
    assert {(r.query_id, r.target_id) for r in got} == want


def test_features(spark):
    rows = [(1, ("HOLA", "HOLA MUNDO"), 1), (1, ("", ""), 0), (1, ("mira 😀😀 http://a.b", "www.x.y 😀 z 😀"), 0)]
    df = spark.createDataFrame([(c, (i, a, "u", T0), (i + 10, b, "u", T0), lab, "random", 0.0, 1) for i, (c, (a, b), lab) in enumerate(rows)],
                               "chat_id long, a struct<id:long,text:string,user_key:string,ts:timestamp>, b struct<id:long,text:string,user_key:string,ts:timestamp>, label int, kind string, time_delta_min double, same_author int")
    f = {r.a.id: r.features_extra for r in P.enrich(df).collect()}
    assert f[0].both_all_caps == 1 and f[0].tfidf_jaccard == 0.5 and f[0].seq_ratio == 0.4
    assert f[1].tfidf_jaccard == 1.0 and f[1].seq_ratio == 0.0 and f[1].both_all_caps == 0
    assert f[2].both_have_url == 1 and f[2].emoji_diff == 1


def test_augmentation_is_light_and_repeatable(spark):
    p = P.build_pairs(messages(spark))
    a, b = P.augment(p, p_swap=0.0, p_punct=0.0, p_case=0.0), P.augment(p)
    assert a.select("a.text").exceptAll(p.select("a.text")).count() == 0
    key = ["chat_id", "a.id", "b.id", "kind"]
    again = P.augment(p)
    assert b.select(*key, "a.text").exceptAll(again.select(*key, "a.text")).count() == 0
    changed = b.select("a.text").exceptAll(p.select("a.text")).count() / p.count()
    assert 0.0 < changed < 0.35


def stats(spark, ratios):
    return spark.createDataFrame([(i, p, 1 - p - h, h) for i, (p, h) in enumerate(ratios)], "chat_id long, pos_ratio double, neg_ratio double, hard_ratio double")


def test_fold_strategy(spark):
    pick = lambda r: P.fold_strategy(stats(spark, r)).first().strategy
    assert pick([(0.05, 0.5)]) == "row_folds"
    assert pick([(0.05, 0.5), (0.051, 0.501)]) == "group_folds"
    assert pick([(0.05, 0.2), (0.05, 0.6)]) == "cluster_folds"


def test_group_folds_and_holdout_keep_chats_whole(spark):
    p = P.build_pairs(messages(spark, 40, 6))
    per = P.group_folds(p, 3).groupBy("chat_id").agg(F.countDistinct("fold").alias("n")).collect()
    assert len(per) == 6 and all(r.n == 1 for r in per)
    train, held = P.split_holdout(p, 0.2)
    assert held.count() >= 0.2 * p.count() and train.join(held, "chat_id", "left_semi").count() == 0
    total = p.count()
    s = P.sample_chats(p, total // 2)
    assert s.count() <= total // 2 and s.join(p, "chat_id", "left_anti").count() == 0


def test_binary_metrics_match_hand_values(spark):
    df = spark.createDataFrame([(1, 0.9), (1, 0.4), (0, 0.6), (0, 0.4), (0, 0.1)], "label int, score double")
    m = E.binary_metrics(df).first()
    assert (m.precision, m.recall, m.f1) == (0.5, 0.5, 0.5)
    assert abs(m.auc - (3 + 1.5) / 6) < 1e-12
    assert E.roc_auc(df.filter("label = 1")).first().auc == 0.0


def test_confusion_matrix_has_empty_cells(spark):
    df = spark.createDataFrame([(0, 0), (1, 0)], "label long, prediction long")
    got = {(r.label, r.prediction): r.n for r in E.confusion_matrix(df, [0, 1]).collect()}
    assert got == {(0, 0): 1, (0, 1): 0, (1, 0): 1, (1, 1): 0}
    errors = E.error_table(df.withColumn("score", F.lit(-0.5))).collect()
    assert [(e.error_type, e.abs_score) for e in errors] == [("FN", 0.5)]


def test_models_learn_a_line(spark):
    rng = np.random.default_rng(0)
    rows = [([float(a), float(b)], int(a + b > 0)) for a, b in rng.normal(size=(300, 2))]
    df = spark.createDataFrame(rows, "vector array<double>, label int")
    for kind in ("naive_bayes", "logistic", "forest"):
        m = E.train(df, kind, trees=10)
        assert E.binary_metrics(E.score(m, df)).first().auc > 0.9, kind


def test_perceptron_keeps_its_best_epoch(spark, monkeypatch):
    """Epochs go on from the weights before; a worse later epoch is not kept, and the loop ends by itself."""
    rng = np.random.default_rng(0)
    points = rng.normal(size=(400, 2))
    rows = [([float(a), float(b)], int(a * b > 0)) for a, b in points]
    train = spark.createDataFrame(rows[:250], "vector array<double>, label int")
    valid = spark.createDataFrame(rows[250:], "vector array<double>, label int")
    model, history = E.train_epochs(train, valid, epochs=8, steps=15, patience=3, hidden=(8, 4))
    losses = [h[1] for h in history]
    assert [h[0] for h in history] == list(range(1, len(history) + 1)) and losses[-1] < losses[0]
    best = max(h[4] for h in history)
    kept = E.binary_metrics(E.score(model, valid).withColumn("score", F.col("prediction"))).first().f1
    assert abs(kept - best) < 1e-12 and best > 0.8

    # measures that get worse after the second epoch
    measured = iter([(0.5, 0.5, 0.5), (0.9, 0.9, 0.9), (0.8, 0.8, 0.8), (0.9, 0.9, 0.9), (0.1, 0.1, 0.1)])
    fits = []

    whole = E.hit_measures

    def fake(df):
        fits.append(1)
        return dict(zip(("precision", "recall", "f1"), next(measured)))

    monkeypatch.setattr(E, "hit_measures", fake)
    model, history = E.train_epochs(train, valid, epochs=20, steps=2, patience=3, hidden=(4,))
    monkeypatch.setattr(E, "hit_measures", whole)
    assert len(history) == 5 and len(fits) == 5  # ended three epochs after the best
    again, _ = E.train_epochs(train, valid, epochs=2, steps=2, patience=3, hidden=(4,))
    assert np.allclose(model.stages[-1].weights.toArray(), again.stages[-1].weights.toArray()) or history[1][4] == 0.9


def test_isolation_forest_ranks_the_outlier_first(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(v) for v in rng.normal(size=3)]) for i in range(200)] + [(999, [9.0, 9.0, 9.0])]
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    table, anomaly = E.isolation_forest(df, F.col("id"), trees=25)
    assert table.select("tree").distinct().count() == 25
    assert df.withColumn("s", anomaly("vector")).orderBy(F.col("s").desc()).first().id == 999


def test_signature(spark):
    m = spark.createDataFrame([("b.json",), ("a.json",), ("a.json",)], "file string")
    s = P.signature(m, "hash", take=10)
    assert s.first().files == ["a.json", "b.json"] and s.first().total_messages == 3
    assert P.is_current(s, P.signature(m, "hash", take=10)) and not P.is_current(s, P.signature(m, "hash", take=9))


def chats(spark, sizes):
    rows = [(k, i) for k, n in sizes.items() for i in range(n)]
    return spark.createDataFrame(rows, "chat_id long, id long")


def test_runs_of_the_lightest_fold_are_the_walk():
    import random

    r = random.Random(4)
    for trial in range(200):
        n, folds = r.randrange(1, 60), r.randrange(1, 7)
        sizes = sorted((r.choice([1, 1, 1, 2, 3, 7, 20, 100]) for _ in range(n)), reverse=True)
        load, want = [0] * folds, []
        for c in sizes:
            at = min(range(folds), key=lambda f: (load[f], f))
            load[at] += c
            want.append((c, at))
        counts = {c: sizes.count(c) for c in set(sizes)}
        runs = P.lightest_runs(counts, folds)
        got = []
        for c in sorted(counts, reverse=True):
            own = [x for x in runs if x[0] == c]
            for k, (_, rank, turn) in enumerate(own):
                end = own[k + 1][1] if k + 1 < len(own) else counts[c]
                got += [(c, turn[i % len(turn)]) for i in range(end - rank)]
        assert got == want
        assert len(runs) <= (folds + 2) * len(counts)
    assert len(P.lightest_runs({1: 10 ** 12, 5: 3, 10 ** 6: 2}, 5)) < 30  # many chats of a size are no many steps


def test_group_folds_of_many_chats(spark):
    import random

    r = random.Random(1)
    sizes = {k: r.choice([1, 1, 2, 3, 9, 30]) for k in range(120)}
    p = chats(spark, sizes)
    got = {x.chat_id: x.fold for x in P.group_folds(p, 5).select("chat_id", "fold").distinct().collect()}
    load, want = [0] * 5, {}
    for k in sorted(sizes, key=lambda k: (-sizes[k], k)):
        want[k] = min(range(5), key=lambda f: (load[f], f))
        load[want[k]] += sizes[k]
    assert got == want


def test_sampled_chats_are_the_walk(spark):
    import random

    for seed in range(3):
        r = random.Random(seed)
        sizes = {k: r.choice([1, 2, 5, 40, 90, 130]) for k in range(40)}
        p = chats(spark, sizes)
        order = [x.chat_id for x in P.chat_order(p.select("chat_id").distinct(), 42).orderBy("o", "chat_id").collect()]
        for most in (1, 100, 333, 10 ** 6):
            total, want = 0, set()
            for k in order:
                if total + sizes[k] <= most:
                    total += sizes[k]
                    want.add(k)
            assert {x.chat_id for x in P.sample_chats(p, most).select("chat_id").distinct().collect()} == want
    assert P.sample_chats(p.limit(0), 10).count() == 0


def test_running_total(spark):
    from tertulia.operators import ranking as R

    df = spark.createDataFrame([(k % 3 or None, k * 37 % 101, k) for k in range(60)], "g int, o long, v long")
    got = {r.v: (r.before, r["all"]) for r in R.running_total(df, ["g"], ["o", "v"], "v", F.floor(F.col("o") / 10)).collect()}
    rows = df.collect()
    for r in rows:
        same = [x for x in rows if x.g == r.g]
        assert got[r.v] == (sum(x.v for x in same if (x.o, x.v) < (r.o, r.v)), sum(x.v for x in same))


def test_pair_features_meet_by_ids(spark):
    """Null and equal texts, repeated pairs; no distance unless asked for, and no whole text in a join key."""
    side = "struct<id:long,text:string>"
    rows = [((1, "hola mundo"), (2, "hola mundos")), ((1, "hola mundo"), (2, "hola mundos")), ((3, None), (4, "")), ((5, "HOLA 😀"), (6, "hola 😀😀 😀 http://a.b")), ((7, "ABC"), (8, "XYZ"))]
    p = spark.createDataFrame(rows, f"a {side}, b {side}")
    got = [r.features_extra for r in P.enrich(p).orderBy("a.id").collect()]

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
        return row[-1]

    texts = [(a[1] or "", b[1] or "") for a, b in rows]
    assert np.allclose([x.seq_ratio for x in got], [1 - distance(a, b) / max(len(a), len(b)) if a and b else 0.0 for a, b in texts])
    assert [(x.len_a, x.len_b) for x in got] == [(len(a), len(b)) for a, b in texts]
    assert [x.both_all_caps for x in got] == [0, 0, 0, 0, 1] and got[3].emoji_diff == 1
    plain = P.enrich(p, distance=False)
    text = plain._jdf.queryExecution().optimizedPlan().toString()
    assert "levenshtein" not in text.lower() and all(r.features_extra.seq_ratio is None for r in plain.collect())
    joins = [line for line in text.splitlines() if "Join" in line]
    assert joins and not any("text" in line for line in joins)


def test_nearest_with_ties_zeros_and_a_threshold(spark):
    rng = np.random.default_rng(5)
    same = [1.0, 2.0, 0.5, -1.0]
    rows = [(i % 2, i, [float(v) for v in rng.normal(size=4)]) for i in range(120)] + [(0, 200 + i, same) for i in range(40)] + [(0, 300, [0.0] * 4), (1, 301, [0.0] * 4), (5, 302, same)]
    df = spark.createDataFrame(rows, "chat_id long, id long, embedding array<double>")
    for least in (-2.0, 0.35):
        got = {}
        for r in P.nearest_in_chat(df.withColumnRenamed("id", "query_id"), df.withColumnRenamed("id", "target_id"), 7, block=32, least=least).collect():
            got.setdefault((r.chat_id, r.query_id), []).append((r.place, r.target_id, r.sim))
        for chat, i, v in rows:
            unit = lambda x: np.array(x) / max(np.linalg.norm(x), 1e-300)
            sims = sorted((-round(float(unit(v) @ unit(w)), 9), j) for c, j, w in rows if c == chat)[:7]
            want = [(-s, j) for s, j in sims if -s >= least]
            have = sorted(got.get((chat, i), []))
            assert [p for p, _, _ in have] == list(range(1, len(want) + 1))
            assert np.allclose([s for _, _, s in have], [s for s, _ in want], atol=1e-8)
            if len({s for s, _ in want}) == len(want):
                assert [j for _, j, _ in have] == [j for _, j in want]


def test_bounds_leave_most_products_out_on_clustered_data():
    from tertulia.operators import neighbours as N

    rng = np.random.default_rng(1)
    centres = N.unit(rng.normal(size=(40, 16)))
    x = N.unit(np.concatenate([c + 0.02 * rng.normal(size=(50, 16)) for c in centres]))
    cell = N.gathered(x, 40)
    parts = [np.flatnonzero(cell == c) for c in np.unique(cell)]
    cones = [N.cone(x[p]) for p in parts]
    stack, radii, sizes = np.stack([c for c, _ in cones]), np.array([r for _, r in cones]), np.array([len(p) for p in parts])
    tried = done = 0
    for p, (c, r) in zip(parts, cones):
        best = N.Best(p, x[p], c, r, 10)
        high = N.needed(c[None], [r], stack, radii, sizes, 10, 0.35)
        for j in np.argsort(-high):
            if high[j] > -2:
                tried += 1
                done += best.offer(parts[j], x[parts[j]], *cones[j], 0.35)
        sims = np.round(x[p] @ x.T, 12)
        assert np.allclose(best.sim, -np.sort(-sims, axis=1)[:, :10])
    assert done <= tried < 0.5 * len(parts) ** 2 and done < 0.2 * len(parts) ** 2


def test_rows_for_training_lie_in_bounded_parts_on_disk(spark, monkeypatch):
    monkeypatch.setattr(E, "ROWS_PER_PART", 10)
    rows = E.training_rows(spark.range(400))
    assert rows.rdd.getNumPartitions() == 40 and rows.count() == 400
    assert rows.storageLevel.useDisk and not rows.storageLevel.useMemory
    rows.unpersist()


def test_heuristic_scores_join_no_texts(spark):
    side = "struct<id:long,text:string,ts:timestamp>"
    rows = [(1, (1, "¿cuánto cuesta?", T0), (2, "cuesta 20 usd", T0 + dt.timedelta(minutes=1))), (1, (1, None, T0), (3, "", T0)), (1, (1, "¿cuánto cuesta?", T0), (2, "cuesta 20 usd", T0 + dt.timedelta(minutes=1)))]
    p = spark.createDataFrame(rows, f"chat_id int, a {side}, b {side}")
    scored = E.heuristic_scores(p)
    plan = scored.select("score")._jdf.queryExecution().optimizedPlan().toString()
    keys = {x for line in plan.splitlines() if "Join" in line for x in re.findall(r"\b_[ab]#\d+", line)}
    assert len(keys) == 4 and all(re.search(r"unhex\(md5\([^\n]* AS " + k, plan) or re.search(r"unhex\(md5\([^\n]* AS tid#", plan) for k in keys)
    got = {r.b.id: r.score for r in scored.collect()}
    assert scored.count() == 3 and scored.columns == [*p.columns, "score"]
    assert got[2] > got[3]


def test_pair_vectors_hold_no_zeros_and_score_alike(spark):
    """Models read packed vectors, whose zeros are not stored, and find what they find on arrays."""
    rng = np.random.default_rng(3)
    rows = []
    for k in range(240):
        v = [0.0] * 40
        v[k % 30] = 1.0
        v[-1], v[-2] = (float(x) for x in rng.normal(size=2))
        rows.append((k, v, int(v[-1] + v[-2] > 0)))
    plain = spark.createDataFrame(rows, "id long, vector array<double>, label int")
    tight = E.packed(plain, 40)
    assert tight.columns == ["id", "label", "features"]
    assert all(len(r.features.indices) <= 3 and r.features.toArray().tolist() == rows[r.id][1] for r in tight.collect())
    scores = lambda m, df: {r.id: r.score for r in E.score(m, df).collect()}
    for kind in ("naive_bayes", "logistic"):
        a, b = (scores(E.train(df, kind), df) for df in (plain, tight))
        assert all(abs(a[k] - b[k]) < 1e-9 for k in a), kind
    # what the regression is fitted on keeps its zeros unwritten too
    m = E.train(tight, "logistic")
    assert all(len(r.scaled.indices) <= 3 for r in m.stages[0].transform(tight).collect())
    a, b = (E.isolation_forest(df, F.col("id"), trees=10, sample=64) for df in (plain, tight))
    assert sorted(a[0].collect()) == sorted(b[0].collect())


def test_epochs_keep_unscaled_rows(spark, monkeypatch):
    kept = []
    whole = E.training_rows
    monkeypatch.setattr(E, "training_rows", lambda df: kept.append(df.columns) or whole(df))
    df = spark.createDataFrame([([float(k % 5), 0.0, 0.0, float(k % 2)], k % 2) for k in range(80)], "vector array<double>, label int")
    E.train_epochs(E.packed(df, 4), E.packed(df, 4), epochs=1, steps=2, hidden=(3,))
    assert kept == [["features", "label"]] * 2


def test_edit_distances_of_a_batch_and_no_distance_per_row(spark):
    """Lengths around whole words, empty texts, signs beyond 16 bits; distances are not worked out row by row in the plan."""
    from tertulia.functions.edits import edit_distances

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
        return row[-1]

    rng = random.Random(5)
    made = lambda: "".join(rng.choice(signs) for _ in range(rng.choice([0, 1, 7, 63, 64, 65, 128, 150])))
    a, b = [], []
    for signs in ("ab", "abcde ñé", "😀漢字abc"):
        for _ in range(40):
            a.append(made())
            b.append(rng.choice([made(), a[-1], a[-1][3:] + made()[:9], "".join(x if rng.random() < 0.9 else "z" for x in a[-1])]))
    assert edit_distances(a, b).tolist() == [distance(x, y) for x, y in zip(a, b)]
    side = "struct<id:long,text:string>"
    p = spark.createDataFrame([((i, x), (i, y)) for i, (x, y) in enumerate(zip(a, b))], f"a {side}, b {side}")
    got = {r.a.id: r.features_extra.seq_ratio for r in P.enrich(p).collect()}
    assert np.allclose([got[i] for i in range(len(a))], [1 - distance(x, y) / max(len(x), len(y)) if x and y else 0.0 for x, y in zip(a, b)])
    assert "levenshtein" not in P.enrich(p)._jdf.queryExecution().optimizedPlan().toString().lower()


def test_perceptron_steps_are_those_of_spark_on_blocks(spark, monkeypatch):
    """Equal weights after some steps as the library's own trainer, with and without zeros; rows are kept as blocks of bounded size."""
    from pyspark.ml.classification import MultilayerPerceptronClassifier
    from pyspark.ml.feature import StandardScaler
    from tertulia.operators import perceptron as N

    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 70)) * (rng.random((300, 70)) < 0.02) + 0.0
    x[:, 0] = rng.normal(size=300)
    x[:, 1] = 5.0
    rows = [([float(v) for v in r], int(r[0] + r[2] > 0)) for r in x]
    plain = spark.createDataFrame(rows, "vector array<double>, label int").coalesce(1)
    data = E.packed(plain, 70)
    monkeypatch.setattr(N, "ROWS_PER_BLOCK", 128)
    scaler = StandardScaler(inputCol="features", outputCol="scaled", withMean=True).fit(data)
    std = scaler.std.toArray()
    net = N.Net([70, 5, 3, 2], scaler.mean.toArray(), np.divide(1.0, std, out=np.zeros_like(std), where=std != 0))
    table = N.blocks(data.select("features", "label"))
    assert sorted(r.rows for r in table.collect()) == [44, 128, 128]
    whole = MultilayerPerceptronClassifier(featuresCol="scaled", layers=[70, 5, 3, 2], maxIter=6, seed=42).fit(scaler.transform(data))
    begin = MultilayerPerceptronClassifier(featuresCol="scaled", layers=[70, 5, 3, 2], maxIter=0, seed=42).fit(scaler.transform(data))
    for dense, at_once in ((0.0, 32), (1.0, 32), (1 / 32, 1)):
        monkeypatch.setattr(N, "_DENSE", dense)
        monkeypatch.setattr(N, "SUMS_AT_ONCE", max(2, at_once))
        weights, loss = N.minimized(lambda w: N.mean_loss(table.repartition(5), net, w), begin.weights.toArray(), 6)
        assert np.allclose(weights, whole.weights.toArray(), atol=1e-6) and abs(loss - whole.summary().objectiveHistory[-1]) < 1e-8
    said = sorted((r.label, r.prediction) for r in N.predicted(table, net, weights).collect())
    assert said == sorted((float(r.label), r.prediction) for r in whole.transform(scaler.transform(data)).collect())


def test_models_are_trained_side_by_side(spark, monkeypatch):
    """Both lanes run at once, every model is there once, and one that fails is not passed over."""
    import threading

    import pytest
    from tertulia.plans import pairs as Q

    both, asked = threading.Barrier(2, timeout=30), []
    rows = [(f, k % 2, k / 10) for f in range(2) for k in range(10)]

    def scores(spark, d, kind):
        if kind in [lane[0] for lane in Q.LANES]:
            both.wait()
        asked.append(kind)
        if d == "broken" and kind == "naive_bayes":
            raise ValueError(kind)
        return spark.createDataFrame([(kind, *r) for r in rows], "model string, fold int, label int, score double")

    monkeypatch.setattr(Q, "model_scores", scores)
    monkeypatch.setattr(Q, "pair_vectors", lambda spark, d: None)
    got = Q.model_folds(spark, "d").collect()
    kinds = {"naive_bayes", "logistic", "boosted", "forest", "perceptron"}
    assert sorted(asked) == sorted(kinds) and {(r.model, r.fold) for r in got} == {(k, f) for k in kinds for f in range(2)}
    with pytest.raises(ValueError):
        Q.model_folds(spark, "broken")


def test_boosted_trees_on_blocks_are_those_of_spark(spark, monkeypatch):
    """Equal trees and scores as the library's own trainer where no gains tie, ended by the valid rows; zeros take part without being stored."""
    from pyspark.ml.classification import GBTClassifier
    from tertulia.operators import boosting as B, perceptron as N

    rng = np.random.default_rng(8)
    x = np.zeros((900, 8))
    x[:, 0], x[:, 1] = rng.normal(size=900), rng.integers(0, 5, 900)
    x[:, 2] = rng.normal(size=900) * (rng.random(900) < 0.2)
    x[:, 4] = rng.random(900) < 0.3
    y = (x[:, 0] + 2 * x[:, 2] * x[:, 1] + x[:, 4] + rng.normal(size=900) * 0.5 > 0.5).astype(int)
    rows = [([float(v) for v in r], int(k), i % 4 == 0) for i, (r, k) in enumerate(zip(x, y))]
    df = E.packed(spark.createDataFrame(rows, "vector array<double>, label int, valid boolean"), 8)
    monkeypatch.setattr(B, "ROWS_PER_BLOCK", 100)
    monkeypatch.setattr(N, "SUMS_AT_ONCE", 2)
    limits = B.cuts(df.filter("not valid").select("features", "label"), 8, 42)
    assert np.isfinite(limits).sum(1)[[1, 3, 4]].tolist() == [4, 0, 1]
    stored = B.blocks(df.select("features", "label", "valid"), limits).collect()
    assert all(len(r.labels) <= 100 for r in stored) and sum(len(r.labels) for r in stored) == 900
    assert sum(len(r.bin) for r in stored) < 0.5 * 900 * 8
    for rounds, depth in ((12, 2), (2, 4)):
        whole = GBTClassifier(featuresCol="features", maxIter=rounds, maxDepth=depth, stepSize=0.1, seed=42, validationIndicatorCol="valid").fit(df)
        own = B.boosted(df.select("features", "label", "valid"), 8, rounds, depth, 42)
        assert own.getNumTrees == whole.getNumTrees and own.treeWeights == whole.treeWeights
        a, b = ([r.probability[1] for r in m.transform(df).collect()] for m in (whole, own))
        assert np.allclose(a, b, atol=1e-9)
    model = E.train(df, "boosted", trees=5, valid="valid")
    assert E.binary_metrics(E.score(model, df)).first().auc > 0.85
