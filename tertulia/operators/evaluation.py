"""Classifiers on pair vectors and their measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from . import graph as G


def heuristic_scores(pairs: DataFrame) -> DataFrame:
    """Reply probability of every pair from its own two messages."""
    from ..functions import text as X
    from .matches import prepared
    from .pairs import text_id

    def texts(df):
        t = df.select("a.text").unionByName(df.select("b.text")).select(F.coalesce("text", F.lit("")).alias("text")).distinct()
        t = t.select(text_id(F.col("text")).alias("tid"), "text")
        return prepared(t).select("tid", X.content_words(F.col("text")).alias("words"), X.intention(F.col("text")).alias("intention"),
                        G.pattern_set("text").alias("patterns"))

    f = texts(pairs)
    side = lambda p: f.select(F.col("tid").alias(f"_{p}"), *[F.col(c).alias(f"{p}_{c}") for c in ("words", "intention", "patterns")])
    c = F.col
    blank = F.lit("")
    low = lambda p: F.lower(F.coalesce(f"{p}.text", blank))
    # the pairs meet what was found in their texts by the texts' ids; what needs both texts is worked out before
    ids = {f"_{p}": text_id(F.coalesce(f"{p}.text", blank)) for p in "ab"}
    j = pairs.withColumns({**ids, "_social": G.social_factor(blank, blank, low("a"), low("b"))}).join(side("a"), "_a").join(side("b"), "_b")
    return j.select(
        *pairs.columns,
        G.probability(G.temporal_factor(c("a.ts"), c("b.ts")),
                      G.semantic_factor(c("a_words"), c("b_words"), c("a_patterns"), c("b_patterns")),
                      c("_social"),
                      G.structural_factor(c("a_intention"), c("b_intention"))).alias("score"))


def binary_metrics(scored: DataFrame, threshold: float = 0.5, by: list[str] | None = None) -> DataFrame:
    """Precision, recall, F1 at a cut, and exact ROC AUC; zero where undefined."""
    by = by or []
    hit = F.col("score") >= threshold
    pos = F.col("label") == 1
    g = scored.groupBy(*by).agg(F.count_if(hit & pos).alias("tp"), F.count_if(hit & ~pos).alias("fp"), F.count_if(~hit & pos).alias("fn"))
    div = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    p, r = div(F.col("tp"), F.col("tp") + F.col("fp")), div(F.col("tp"), F.col("tp") + F.col("fn"))
    out = g.select(*by, p.alias("precision"), r.alias("recall"))
    out = out.withColumn("f1", div(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    auc = roc_auc(scored, by)
    return out.join(auc, by) if by else out.join(F.broadcast(auc))  # one row each


def roc_auc(scored: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Exact area under the ROC curve by rank sums.

    Rows are first counted per distinct score; buckets of the score chain the
    cumulative counts, so no task sorts more than one bucket.
    """
    from .ranking import value_bucket

    by = by or []
    c = scored.groupBy(*by, "score").agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") != 1).alias("q")).withColumn(
        "_b", value_bucket("score"))
    b = c.groupBy(*by, "_b").agg(F.sum("q").alias("bq"))
    run = W.partitionBy(*by).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    b = b.select(*by, "_b", F.coalesce(F.sum("bq").over(run), F.lit(0)).alias("below"))
    inside = W.partitionBy(*by, "_b").orderBy("score").rowsBetween(W.unboundedPreceding, -1)
    j = c.join(b, [*by, "_b"]).withColumn("less", F.col("below") + F.coalesce(F.sum("q").over(inside), F.lit(0)))
    s = j.groupBy(*by).agg(F.sum(F.col("p") * (F.col("less") + F.col("q") / 2.0)).alias("u"), F.sum("p").alias("np"), F.sum("q").alias("nq"))
    return s.select(*by, F.when((F.col("np") > 0) & (F.col("nq") > 0), F.col("u") / (F.col("np") * F.col("nq"))).otherwise(0.0).alias("auc"))


def confusion_counts(pred: DataFrame) -> DataFrame:
    return pred.groupBy("label", "prediction").agg(F.count("*").alias("n"))


def class_report(pred: DataFrame, labels: list[int]) -> DataFrame:
    """Precision, recall, F1 and support of each label; works on the label-by-prediction counts."""
    # at most labels x labels cells, gathered in one row
    cells = confusion_counts(pred).agg(F.collect_list(F.struct("label", "prediction", "n")).alias("cells"))
    g = cells.select("cells", F.explode(F.array(*[F.lit(int(x)).cast("long") for x in labels])).alias("k"))
    total = lambda cond: F.aggregate(F.filter("cells", cond), F.lit(0).cast("long"), lambda a, x: a + x["n"])
    k = F.col("k")
    tp = total(lambda x: (x["label"] == k) & (x["prediction"] == k))
    sup, got = total(lambda x: x["label"] == k), total(lambda x: x["prediction"] == k)
    div = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    out = g.select(k.alias("label"), div(tp, got).alias("precision"), div(tp, sup).alias("recall"), sup.alias("support"))
    return out.withColumn("f1", div(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def overall_metrics(pred: DataFrame, labels: list[int]) -> DataFrame:
    """Accuracy and support-weighted precision, recall and F1."""
    r = class_report(pred, labels)
    w = lambda c: (F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias("weighted_" + c)
    acc = (F.sum(F.col("recall") * F.col("support")) / F.sum("support")).alias("accuracy")
    return r.agg(acc, w("precision"), w("recall"), w("f1"))


def confusion_matrix(pred: DataFrame, labels: list[int]) -> DataFrame:
    """Every cell over the fixed label order, empty ones as zero."""
    cells = [(int(a), int(b)) for a in labels for b in labels]
    grid = pred.sparkSession.createDataFrame(cells, "label long, prediction long")
    return grid.join(confusion_counts(pred), ["label", "prediction"], "left").fillna(0, ["n"])


def error_table(pred: DataFrame) -> DataFrame:
    wrong = pred.filter(F.col("label") != F.col("prediction"))
    kind = F.when((F.col("label") == 1) & (F.col("prediction") == 0), "FN").when((F.col("label") == 0) & (F.col("prediction") == 1), "FP").otherwise("other")
    return wrong.withColumn("error_type", kind).withColumn("abs_score", F.abs("score"))


def best_fold(metrics: DataFrame) -> DataFrame:
    """Best fold per model by F1, first fold on a tie."""
    top = F.min(F.struct((-F.col("f1")).alias("neg"), "fold"))
    return metrics.groupBy("model").agg(top.alias("t")).select("model", F.col("t.fold").alias("fold"), (-F.col("t.neg")).alias("f1"))


def stratified_split(df: DataFrame, label: str, ident: str, share: float = 0.2, seed: int = 42) -> DataFrame:
    """Adds ``is_test``: of each label the rounded share of its rows with the least draws.

    A label's draws are cut into 1024 ranges, so no task sorts a whole label.
    """
    from .pairs import draw
    from .ranking import ordered_rank

    drawn = df.withColumn("_d", draw(seed, F.col(ident), F.col(label)))
    ranked = ordered_rank(drawn, [label], ["_d", ident], F.floor(F.col("_d") / (1 << 21)))
    return ranked.withColumn("is_test", F.col("rn") <= F.round(F.col("n") * share)).drop("_d", "rn", "n")


def packed(pairs: DataFrame, width: int) -> DataFrame:
    """The array ``vector`` of `width` numbers as the ML vector ``features``, which holds only what is not zero where that is shorter.

    Term-hash vectors are nearly all zeros: whoever trains or scores reads some twenty numbers a row instead of `width`.
    """
    from pyspark.ml.feature import VectorAssembler, VectorSizeHint
    from pyspark.ml.functions import array_to_vector

    whole = pairs.withColumn("_whole", array_to_vector("vector"))
    sized = VectorSizeHint(inputCol="_whole", size=width, handleInvalid="optimistic").transform(whole)
    out = VectorAssembler(inputCols=["_whole"], outputCol="features").transform(sized)
    return out.select(*[c for c in pairs.columns if c != "vector"], F.col("features").alias("features", metadata={}))


def _features(pairs: DataFrame) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    return pairs if "features" in pairs.columns else pairs.withColumn("features", array_to_vector("vector"))


def train(pairs: DataFrame, kind: str, seed: int = 42, trees: int | None = None, valid: str | None = None):
    """A fitted model on (vector, label): naive_bayes, logistic, boosted, forest or perceptron."""
    from pyspark.ml import Pipeline, PipelineModel, classification as C
    from pyspark.ml.feature import StandardScaler

    data = _features(pairs)
    scaled = StandardScaler(inputCol="features", outputCol="scaled", withMean=True)
    # the regression centres its features itself, without writing the zeros out; its weights and scores are those of centred rows
    spread_only = StandardScaler(inputCol="features", outputCol="scaled")
    base = dict(labelCol="label")
    if kind == "naive_bayes":
        stages = [C.NaiveBayes(modelType="gaussian", featuresCol="features", **base)]
    elif kind == "logistic":
        stages = [spread_only, C.LogisticRegression(featuresCol="scaled", maxIter=1000, regParam=1e-4, **base)]
    elif kind == "boosted":
        from .boosting import boosted

        held = F.col(valid) if valid else F.lit(False)
        size = data.select("features").first()[0].size
        return PipelineModel(stages=[boosted(data.select("features", "label", held.alias("valid")), size, rounds=trees or 200, depth=5, seed=seed)])
    elif kind == "forest":
        stages = [C.RandomForestClassifier(featuresCol="features", numTrees=trees or 100, maxDepth=12, seed=seed, **base)]
    elif kind == "perceptron":
        width = data.select("features").first()[0].size
        stages = [scaled, C.MultilayerPerceptronClassifier(featuresCol="scaled", layers=[width, 256, 64, 2], maxIter=trees or 50, seed=seed, **base)]
    else:
        raise ValueError(kind)
    return Pipeline(stages=stages).fit(data)


def hit_measures(pred: DataFrame) -> dict[str, float]:
    """Precision, recall and F1 of predictions 0 and 1, from one count."""
    right, said, there = pred.agg(F.count_if((F.col("prediction") == 1) & (F.col("label") == 1)), F.count_if(F.col("prediction") == 1), F.count_if(F.col("label") == 1)).first()
    p, r = right / said if said else 0.0, right / there if there else 0.0
    return {"precision": p, "recall": r, "f1": 2 * p * r / (p + r) if p + r else 0.0}


EPOCHS = "epoch int, loss double, precision double, recall double, f1 double"


ROWS_PER_PART = 8192


def training_rows(df: DataFrame) -> DataFrame:
    """Rows that many epochs read: on the executors' disks, in parts whose size does not grow with the table.

    The trainer keeps its own blocks of them in memory as far as there is room.
    """
    from pyspark import StorageLevel

    from ..session import materialize

    kept = materialize(df, "training")
    cores = df.sparkSession.sparkContext.defaultParallelism
    return kept.repartition(max(cores, -(-kept.count() // ROWS_PER_PART))).persist(StorageLevel.DISK_ONLY)


def train_epochs(pairs: DataFrame, valid: DataFrame, epochs: int = 8, steps: int = 4, patience: int = 2, seed: int = 42,
                 hidden: tuple[int, ...] = (256, 64)):
    """A perceptron trained in epochs, each taking up the weights of the one before, and the measures of every epoch.

    After an epoch of `steps` iterations its F1 on ``valid`` is measured; the
    model returned has the weights of the best epoch (the first of equals).
    Training ends by itself when `patience` epochs in a row were no better, or
    after `epochs`.  Returns (model, list of (epoch, loss, precision, recall, f1)).
    """
    import numpy as np
    from pyspark.ml import PipelineModel, classification as C
    from pyspark.ml.feature import StandardScaler
    from pyspark.ml.linalg import Vectors

    from . import perceptron as N

    scaler = StandardScaler(inputCol="features", outputCol="scaled", withMean=True).fit(_features(pairs))
    # rows lie on disk as they are and are scaled as they are read, since centring leaves no zeros
    kept = [training_rows(_features(df).select("features", "label")) for df in (pairs, valid)]
    rows, held = (N.blocks(df) for df in kept)
    for df in kept:
        df.unpersist()
    mean, std = scaler.mean.toArray(), scaler.std.toArray()
    layers = [len(mean), *hidden, 2]
    net = N.Net(layers, mean, np.divide(1.0, std, out=np.zeros_like(std), where=std != 0))

    def classifier(weights=None):
        """Spark ML's classifier on given weights, or on those it would begin with."""
        blank = pairs.sparkSession.createDataFrame([(Vectors.sparse(len(mean), {}), float(k)) for k in (0, 1)], ["scaled", "label"])
        begun = {} if weights is None else {"initialWeights": Vectors.dense(weights)}
        return C.MultilayerPerceptronClassifier(featuresCol="scaled", labelCol="label", layers=layers, maxIter=0, seed=seed, **begun).fit(blank)

    best, history, weights = None, [], classifier().weights.toArray()
    for epoch in range(1, epochs + 1):
        weights, loss = N.minimized(lambda w: N.mean_loss(rows, net, w), weights, steps)
        m = hit_measures(N.predicted(held, net, weights))
        history.append((epoch, float(loss), float(m["precision"]), float(m["recall"]), float(m["f1"])))
        if best is None or m["f1"] > best[0]:
            best = (m["f1"], epoch, weights)
        if epoch - best[1] >= patience:
            break
    return PipelineModel(stages=[scaler, classifier(best[2])]), history


def score(model, pairs: DataFrame) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    out = model.transform(_features(pairs))
    return out.withColumn("score", F.get(vector_to_array("probability"), F.lit(1))).withColumn("prediction", F.col("prediction").cast("long")).drop(
        "features", "scaled", "rawPrediction", "probability")


def cross_scores(pairs: DataFrame, kind: str, folds: int = 5, seed: int = 42, **options) -> DataFrame:
    """Every row scored by a model that was trained without its ``fold``.

    Boosted trees and the perceptron's epochs stop when they no longer gain on
    the fold after it.
    """
    return cross_scores_and_epochs(pairs, kind, folds, seed, **options)[0]


def cross_scores_and_epochs(pairs: DataFrame, kind: str, folds: int = 5, seed: int = 42, **options) -> tuple[DataFrame, DataFrame]:
    """The scores, and what the epochs measured: fold, epoch, loss, precision, recall, f1, kept (perceptron only, else empty)."""
    from concurrent.futures import ThreadPoolExecutor

    from pyspark import inheritable_thread_target

    # the perceptron and the boosted trees are many short passes that hold no rows in memory, so that the folds share the cores;
    # the forest and the regression keep the rows of a fold in memory and are fitted one after another
    with ThreadPoolExecutor(folds if kind in ("perceptron", "boosted") else 1) as side:
        fitted = [side.submit(inheritable_thread_target(pairs.sparkSession)(fold_model), pairs, kind, k, folds, seed, **options) for k in range(folds)]
        fitted = [f.result() for f in fitted]
    out, rows = None, []
    for k, (model, history) in enumerate(fitted):
        rows += [(k, *h) for h in history]
        scored = score(model, pairs.filter(F.col("fold") == k))
        out = scored if out is None else out.unionByName(scored)
    table = pairs.sparkSession.createDataFrame(rows, "fold int, " + EPOCHS)
    first = F.min(F.struct(-F.col("f1"), "epoch")).over(W.partitionBy("fold"))["epoch"]
    return out, table.withColumn("kept", F.col("epoch") == first)


def fold_model(pairs: DataFrame, kind: str, k: int, folds: int = 5, seed: int = 42, **options):
    """The model for fold ``k``, trained without it, and what its epochs measured (perceptron only, which takes ``options`` of `train_epochs`)."""
    rest, judge = pairs.filter(F.col("fold") != k), (k + 1) % folds
    if kind == "perceptron":
        return train_epochs(rest.filter(F.col("fold") != judge), rest.filter(F.col("fold") == judge), seed=seed, **options)
    if kind == "boosted":
        return train(rest.withColumn("is_valid", F.col("fold") == judge), kind, seed, valid="is_valid"), []
    return train(rest, kind, seed), []


def as_array(name: str) -> Column:
    """A vector column as an array, whether it is an array or an ML vector (``features``)."""
    from pyspark.ml.functions import vector_to_array

    return vector_to_array(F.col(name)) if name == "features" else F.col(name)


def isolation_forest(pairs: DataFrame, ident: Column, trees: int = 100, sample: int = 256, contamination: float = 0.1, seed: int = 42):
    """Isolation trees grown in parallel, one small sample per tree.

    Each row draws a number per tree; a tree keeps the `sample` rows of
    lowest draw.  Returns (tree table, score function): the trees together are
    at most trees * 2 * sample nodes, which bounds what scoring ships around.
    """
    from pyspark.sql.types import DoubleType
    from .pairs import draw

    shape = "features" if "features" in pairs.columns else "vector"
    plain = as_array(shape)
    n = pairs.count()
    # every row draws for every tree; eight times the sample is enough to hold the lowest draws
    share = 2147483647 * min(1.0, 8.0 * sample / max(n, 1))
    draws = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.struct(t.alias("tree"), draw(seed, F.col("_i"), t).alias("_d")))
    # a row is copied only for the trees it is drawn for
    asks = pairs.withColumn("_i", ident).select(shape, "_i", F.explode(F.filter(draws, lambda x: x["_d"] <= share)).alias("_t")).select(shape, "_i", "_t.*")
    w = W.partitionBy("tree").orderBy("_d", "_i")
    rows = asks.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= sample).select("tree", plain.alias("vector"))

    def grow(key, pdf):
        import numpy as np
        import pandas as pd

        rng = np.random.default_rng(seed + int(key[0]))
        x = np.stack(pdf["vector"].to_numpy())
        limit, out = int(np.ceil(np.log2(max(len(x), 2)))), []

        def add(idx, depth):
            me = len(out)
            out.append(None)
            lo, hi = x[idx].min(axis=0), x[idx].max(axis=0)
            open_ = np.flatnonzero(hi > lo)
            if depth >= limit or len(idx) <= 1 or len(open_) == 0:
                out[me] = (-1, 0.0, -1, -1, len(idx))
                return me
            f = int(rng.choice(open_))
            cut = float(rng.uniform(lo[f], hi[f]))
            left = add(idx[x[idx, f] < cut], depth + 1)
            right = add(idx[x[idx, f] >= cut], depth + 1)
            out[me] = (f, cut, left, right, len(idx))
            return me

        add(np.arange(len(x)), 0)
        t = pd.DataFrame(out, columns=["feature", "cut", "left", "right", "size"])
        t.insert(0, "node", range(len(t)))
        t.insert(0, "tree", int(key[0]))
        return t

    table = rows.groupBy("tree").applyInPandas(
        grow, "tree int, node int, feature int, cut double, left int, right int, size int")
    forest = table.toPandas()  # bounded by trees and sample, not by the data
    used = min(sample, n)

    def path(size):
        import numpy as np

        return 0.0 if size <= 1 else 2.0 * (np.log(size - 1) + 0.5772156649015329) - 2.0 * (size - 1) / size

    trees_ = [g.sort_values("node")[["feature", "cut", "left", "right", "size"]].to_numpy() for _, g in forest.groupby("tree")]

    @F.pandas_udf(DoubleType())
    def anomaly(vectors):
        import numpy as np
        import pandas as pd

        if len(vectors) == 0:
            return pd.Series([], dtype="float64")
        x = np.stack(vectors.to_numpy())
        depth = np.zeros(len(x))
        for t in trees_:
            at = np.zeros(len(x), dtype=int)
            steps = np.zeros(len(x))
            live = t[at, 0] >= 0
            while live.any():
                f = t[at[live], 0].astype(int)
                go = x[np.flatnonzero(live), f] < t[at[live], 1]
                at[live] = np.where(go, t[at[live], 2], t[at[live], 3]).astype(int)
                steps[live] += 1
                live = t[at, 0] >= 0
            depth += steps + np.array([path(s) for s in t[at, 4]])
        return pd.Series(2.0 ** (-(depth / max(len(trees_), 1)) / max(path(used), 1e-9)))

    return table, anomaly


def anomaly_cut(scored: DataFrame, contamination: float = 0.1) -> DataFrame:
    return scored.agg(F.percentile_approx("anomaly", 1.0 - contamination, 100000).alias("cut"))
