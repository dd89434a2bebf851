"""Ordered work in slices against plain sorting, with one key holding most rows."""

import datetime as dt
import random
import statistics

from pyspark.sql import Window, functions as F

from tertulia.operators import ranking as R


def rows():
    rng = random.Random(3)
    out = []
    for i in range(600):
        key = 0 if rng.random() < 0.7 else rng.randint(1, 4)
        out.append((key, i, dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(seconds=rng.randint(0, 200000)), float(rng.randint(-50, 400)) / 4))
    return out


def frame(spark):
    return spark.createDataFrame(rows(), "k long, id long, ts timestamp, v double")


def by_key():
    groups = {}
    for r in rows():
        groups.setdefault(r[0], []).append(r)
    return {k: sorted(g, key=lambda r: (r[2], r[1])) for k, g in groups.items()}


def test_lookback_is_the_last_rows_of_the_key(spark):
    got = R.lookback(frame(spark), ["k"], ["ts", "id"], ["v"], 10, R.time_slice("ts")).collect()
    want = {}
    for g in by_key().values():
        for i, r in enumerate(g):
            want[r[1]] = [p[1] for p in g[max(0, i - 10):i]]
    assert {r.id: [p.id for p in r.prev] for r in got} == want
    assert {r.id: [p.v for p in r.prev] for r in got}[got[0].id] is not None


def test_ordered_rank(spark):
    got = R.ordered_rank(frame(spark), ["k"], ["ts", "id"], R.time_slice("ts")).collect()
    want = {r[1]: (i + 1, len(g)) for g in by_key().values() for i, r in enumerate(g)}
    assert {r.id: (r.rn, r.n) for r in got} == want


def test_exact_median(spark):
    got = {r.k: r.median for r in R.exact_median(frame(spark), ["k"], "v").collect()}
    assert got == {k: statistics.median(r[3] for r in g) for k, g in by_key().items()}


def test_value_bucket_keeps_order(spark):
    values = sorted([-1e6, -3.5, -1.0, -0.999999, -1e-9, 0.0, 1e-12, 0.5, 0.9999999999999999, 1.0, 1.0000000000000002, 2.0, 1023.9999999999999, 1024.0, 7e18])
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", R.value_bucket("v").alias("b")).orderBy("v").collect()
    buckets = [r.b for r in got]
    assert buckets == sorted(buckets)


def test_top_k_per_key(spark):
    got = R.top_k(frame(spark), ["k"], [F.col("v").desc(), "id"], 3).collect()
    want = {(r[0], r[1]) for g in by_key().values() for r in sorted(g, key=lambda r: (-r[3], r[1]))[:3]}
    assert {(r.k, r.id) for r in got} == want


def test_a_hot_slice_is_cut_again(spark, monkeypatch):
    """One hour with most rows, equal times and nulls: the same ranks, and no slice keeps more than a few times its share."""
    from tertulia.operators import ranking as R

    rows = spark.range(20_000).select(
        F.when(F.col("id") % 50 == 0, F.lit(None)).otherwise((F.col("id") % 2)).alias("chat_id"), F.col("id"),
        F.when(F.col("id") % 997 == 0, F.lit(None)).otherwise(F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 7919 % 1000)).alias("ts"))
    order = ["ts", "id"]
    plain = {r.id: (r.rn, r.n) for r in R.ordered_rank(rows, ["chat_id"], order, R.time_slice("ts")).collect()}
    before = {r.id: r.prev for r in R.lookback(rows, ["chat_id"], order, [], 3, R.time_slice("ts")).select("id", F.transform("prev", lambda x: x["id"]).alias("prev")).collect()}
    monkeypatch.setattr(R, "SLICE_ROWS", 500)
    monkeypatch.setattr(R, "PER_CUT", 8)
    sizes = [r["count"] for r in R.sliced_by(rows, ["chat_id"], order, R.time_slice("ts")).groupBy("chat_id", "_slice").count().collect()]
    assert len(sizes) > 20 and max(sizes) < 4 * 500 and sum(sizes) == 20_000
    cut = {r.id: (r.rn, r.n) for r in R.ordered_rank(rows, ["chat_id"], order, R.time_slice("ts")).collect()}
    assert cut == plain
    again = {r.id: r.prev for r in R.lookback(rows, ["chat_id"], order, [], 3, R.time_slice("ts")).select("id", F.transform("prev", lambda x: x["id"]).alias("prev")).collect()}
    assert again == before
    w = Window.partitionBy("chat_id").orderBy(*order)
    want = {r.id: r.rn for r in rows.withColumn("rn", F.row_number().over(w)).collect()}
    assert {k: v[0] for k, v in cut.items()} == want
