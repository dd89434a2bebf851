"""Ordered work inside groups that may be very large.

A group (a chat, a currency) can hold a third of all rows, so nothing here
sorts a whole group in one task.  The group is cut into slices by a monotone
expression of the order (an hour of time, a value bucket); rows are ordered
inside a slice, and the slices are chained through a small per-slice table.
A slice that holds more than SLICE_ROWS rows is cut again, at points of the
whole order taken from a sample of its rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import materialize

SLICE_SECONDS = 3600
SLICE_ROWS = 200_000  # rows of a slice before it is cut again
MOST_CUTS = 255  # cut points inside one slice
PER_CUT = 32  # sampled rows for each cut point


def time_slice(ts: Column | str, seconds: int = SLICE_SECONDS) -> Column:
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.floor(F.unix_seconds(ts) / F.lit(seconds))


def top_k(df: DataFrame, keys: list[str], order: list, k: int) -> DataFrame:
    """First k rows per key; the limit is applied before the shuffle as well."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k).drop("_rn")


def sliced_by(df: DataFrame, keys: list[str], order: list[str], slice_expr: Column) -> DataFrame:
    """Adds ``_slice``, a struct that ascends with the order inside a key and has no more than a task's work of rows.

    Slices are counted first.  Of a slice with more than SLICE_ROWS rows a
    sample is drawn by hash, and every PER_CUT-th sampled row in the order is a
    cut point; a row's place among them is the second part of its slice.  How
    even the cuts are does not matter for results, only that they follow the order.
    """
    first = df.withColumn("_s", slice_expr)
    place = F.struct(*[F.col(c).alias(f"o{k}") for k, c in enumerate(order)])
    narrow = first.select(*keys, "_s", place.alias("_o"))
    names = [*keys, "_s"]
    renamed = [F.col(c).alias(f"_k{k}") for k, c in enumerate(names)]
    same = lambda a, b: [a[c].eqNullSafe(b[f"_k{k}"]) for k, c in enumerate(names)]
    hot = narrow.groupBy(*names).agg(F.count("*").alias("_c")).filter(F.col("_c") > SLICE_ROWS).select(*renamed, "_c")
    wanted = F.least(F.ceil(F.col("_c") / SLICE_ROWS), F.lit(MOST_CUTS)) * PER_CUT
    drawn = narrow.join(hot, same(narrow, hot)).filter(F.pmod(F.xxhash64("_o"), F.greatest(F.lit(1), F.floor(F.col("_c") / wanted))) == 0)
    cuts = drawn.select(*renamed, "_o").groupBy(*[f"_k{k}" for k in range(len(names))]).agg(F.array_sort(F.collect_list("_o")).alias("_a")).withColumn(
        "_cuts", F.filter("_a", lambda x, i: i % PER_CUT == PER_CUT - 1)).drop("_a")
    cuts = materialize(cuts, "cuts")  # of known size, mostly none: rows meet them without a shuffle unless they are many
    met = first.join(cuts, same(first, cuts), "left")
    inner = F.coalesce(F.size(F.filter("_cuts", lambda c: c <= place)), F.lit(0))
    return met.select(*[first[c] for c in df.columns], F.struct(F.col("_s").alias("outer"), inner.alias("inner")).alias("_slice"))


def ordered_rank(df: DataFrame, keys: list[str], order: list[str], slice_expr: Column) -> DataFrame:
    """Adds ``rn`` (1-based position in the key) and ``n`` (key size) without sorting a key in one task."""
    sliced = sliced_by(df, keys, order, slice_expr)
    counts = sliced.groupBy(*keys, "_slice").agg(F.count("*").alias("_c"))
    run = W.partitionBy(*keys).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(
        *keys, "_slice",
        F.coalesce(F.sum("_c").over(run), F.lit(0)).alias("_before"),
        F.sum("_c").over(W.partitionBy(*keys)).alias("n"),
    )
    inside = W.partitionBy(*keys, "_slice").orderBy(*order)
    ranked = sliced.withColumn("_in", F.row_number().over(inside))
    cond = [ranked[c].eqNullSafe(offsets[c]) for c in [*keys, "_slice"]]
    out = ranked.join(offsets, cond)
    return out.select(*[ranked[c] for c in df.columns], (F.col("_before") + F.col("_in")).alias("rn"), offsets["n"])


def running_total(df: DataFrame, keys: list[str], order: list[str], value: str, slice_expr: Column) -> DataFrame:
    """Adds ``before`` (sum of the value over the rows before, in the key) and ``all`` (its sum over the key), slice by slice."""
    sliced = sliced_by(df, keys, order, slice_expr)
    sums = sliced.groupBy(*keys, "_slice").agg(F.sum(value).alias("_c"))
    run = W.partitionBy(*keys).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select(*[F.col(c).alias(f"_k{k}") for k, c in enumerate(keys)], F.col("_slice").alias("_sk"),
                          F.coalesce(F.sum("_c").over(run), F.lit(0)).alias("_before"), F.sum("_c").over(W.partitionBy(*keys)).alias("all"))
    inside = W.partitionBy(*keys, "_slice").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    own = sliced.withColumn("_in", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    out = own.join(offsets, [own["_slice"].eqNullSafe(offsets["_sk"]), *[own[c].eqNullSafe(offsets[f"_k{k}"]) for k, c in enumerate(keys)]])
    return out.select(*[own[c] for c in df.columns], (F.col("_before") + F.col("_in")).alias("before"), "all")


def lookback(df: DataFrame, keys: list[str], order: list[str], payload: list[str], k: int,
             slice_expr: Column, name: str = "prev") -> DataFrame:
    """Adds an array of the up to k preceding rows of the key, oldest first.

    The last k rows of every slice travel to the next slices, so each slice is
    complete on its own.
    """
    item = F.struct(*dict.fromkeys([*order, *payload]))
    sliced = sliced_by(df, keys, order, slice_expr)
    part = [*keys, "_slice"]
    tail = (
        top_k(sliced, part, [F.col(c).desc() for c in order], k)
        .groupBy(*part)
        .agg(F.array_sort(F.collect_list(item)).alias("_tail"))
    )
    before = W.partitionBy(*keys).orderBy("_slice").rowsBetween(-k, -1)
    carry = tail.select(
        *part, F.slice(F.concat(F.array_repeat(F.lit(None).cast(tail.schema["_tail"].dataType.elementType), k),
                                F.flatten(F.collect_list("_tail").over(before))), -k, k).alias("_carry")
    ).withColumn("_carry", F.filter("_carry", lambda x: x.isNotNull()))
    inside = W.partitionBy(*part).orderBy(*order).rowsBetween(-k, -1)
    rows = sliced.withColumn("_own", F.collect_list(item).over(inside))
    short = rows.join(carry, part, "left")
    missing = F.lit(k) - F.size("_own")
    have = F.coalesce(F.size("_carry"), F.lit(0))
    take = F.least(missing, have)
    head = F.when(take > 0, F.slice("_carry", have - take + 1, take)).otherwise(
        F.array().cast(carry.schema["_carry"].dataType)
    )
    return short.select(*df.columns, F.concat(head, F.col("_own")).alias(name))


def value_bucket(value: Column | str) -> Column:
    """Monotone bucket of a number: sign, binary magnitude and 4096 steps inside it."""
    v = F.col(value) if isinstance(value, str) else value
    v = v.cast("double")
    mag = F.floor(F.log2(F.abs(v)))
    step = F.floor((F.abs(v) / F.pow(F.lit(2.0), mag) - 1.0) * 4096)
    code = (mag + 1100) * 4096 + step + 1
    return F.when(v == 0, F.lit(0)).when(v > 0, code).otherwise(-code).cast("long")


def exact_median(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Exact median per key (mean of the two middle values for an even count).

    Values are counted per bucket, only the one or two buckets that hold the
    middle are looked into, and equal values are counted before they are ordered.
    """
    return median_of_counts(value_counts(df, keys, value), keys)


def value_counts(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count("*").alias("_c"))


def median_of_counts(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Median per key from (key, _v, _c) value counts."""
    hist = counts.withColumn("_b", value_bucket("_v"))
    buckets = hist.groupBy(*keys, "_b").agg(F.sum("_c").alias("_bc"))
    run = W.partitionBy(*keys).orderBy("_b")
    spans = (
        buckets.withColumn("_hi", F.sum("_bc").over(run))
        .withColumn("_n", F.sum("_bc").over(W.partitionBy(*keys)))
        .withColumn("_lo", F.col("_hi") - F.col("_bc"))
        .withColumn("_r1", F.floor((F.col("_n") + 1) / 2))
        .withColumn("_r2", F.floor((F.col("_n") + 2) / 2))
        .filter(((F.col("_r1") > F.col("_lo")) & (F.col("_r1") <= F.col("_hi")))
                | ((F.col("_r2") > F.col("_lo")) & (F.col("_r2") <= F.col("_hi"))))
    )
    inside = W.partitionBy(*keys, "_b").orderBy("_v")
    cand = (
        hist.join(spans.drop("_bc"), [*keys, "_b"])
        .withColumn("_e", F.col("_lo") + F.sum("_c").over(inside))
        .withColumn("_s", F.col("_e") - F.col("_c"))
    )
    hit = lambda r: F.when((F.col(r) > F.col("_s")) & (F.col(r) <= F.col("_e")), F.col("_v"))
    return cand.groupBy(*keys).agg(((F.max(hit("_r1")) + F.max(hit("_r2"))) / 2).alias("median"))
