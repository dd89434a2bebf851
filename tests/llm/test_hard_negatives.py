"""Hard negatives against a full table of scores, and to SQL."""

import math
import random

import numpy as np
import pytest

duckdb = pytest.importorskip("duckdb")
pytest.importorskip("public_tokenizers")

from tertulia.llm import hard_negatives as H, queries  # noqa: E402


def slow(rows, every=50, positives=5, negatives=3):
    """Rows (id, vector, label); a row number keeps equal rows apart."""
    good = [(k, i, [math.floor(256 * float(x)) for x in v], lab) for k, (i, v, lab) in enumerate(rows)
            if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for k, i, v, lab in good:
        if i % every:
            continue
        scored = [(-sum(a * b for a, b in zip(v, w)), j, m, same) for m, j, w, l in good if m != k and len(w) == len(v) for same in [l == lab]]
        scored.sort()
        for s, j, _, _ in [x for x in scored if x[3]][:positives]:
            inside = [x for x in scored if not x[3] and 50 * -s <= 100 * -x[0] <= 95 * -s][:negatives]
            out += [(i, j, n + 1, x[1], -s, -x[0]) for n, x in enumerate(inside)]
    return sorted(out)


def stored(spark, tmp_path_factory, rows, schema, parts=3):
    path = str(tmp_path_factory.mktemp("table") / "t")
    spark.createDataFrame(rows, schema).repartition(parts).write.parquet(path)
    return spark.read.parquet(path)


SCHEMA = "vec_id long, embedding array<double>, label int, uid long, g int, rank int"


def vectors(n, seed=3, dims=12, labels=4):
    r = np.random.RandomState(seed)
    centres = r.randn(5, dims)
    out = []
    for i in range(n):
        v = centres[r.randint(5)] * 0.3 + r.randn(dims) * r.choice([0.02, 0.2])
        out.append((i, v.tolist(), int(r.randint(labels))))
    return out


def awkward():
    rows = vectors(400)
    same = rows[100][1]
    rows += [(1000 + k, same, k % 3) for k in range(60)]  # a large group of copies, some under the anchors' labels
    rows += [(2000, None, 1), (2050, [None] * 12, 1), (2100, [float("nan")] * 12, 1), (2150, [float("inf")] * 12, 0), (2200, same, None), (None, same, 1),
             (2250, [0.0] * 12, 2), (2300, [], 1), (2301, [], 1), (2302, [], 2), (2350, [1.0, 2.0], 1), (2351, [2.0, 1.0], 1), (2352, [1.0, 1.5], 2), (2400, [0.5] * 12, 77),
             (-50, same, 1), (2450, [-x for x in same], 1)]
    return rows


def found(df):
    return sorted(tuple(r) for r in df.collect())


def test_against_all_scores(spark, tmp_path_factory):
    rows = awkward()
    df = stored(spark, tmp_path_factory, [(*r, 1, 2, 3) for r in rows], SCHEMA)
    got = H.hard_negatives(df)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = slow(rows)
    assert found(got) == want and len(want) > 50
    assert H.hard_negatives(df.limit(0)).collect() == []


@pytest.mark.parametrize("block,group,step", [(37, 3, 1), (64, 1000, 5)])
def test_blocks_and_groups(spark, tmp_path_factory, monkeypatch, block, group, step):
    monkeypatch.setattr(H, "BLOCK_ROWS", block)
    monkeypatch.setattr(H, "SMALL_BLOCK", block)
    monkeypatch.setattr(H, "GROUP_ANCHORS", group)
    rows = awkward()
    df = stored(spark, tmp_path_factory, [(*r, 1, 2, 3) for r in rows], SCHEMA)
    assert found(H.hard_negatives(df)) == slow(rows)


def test_repeated_rows_and_negative_scores(spark, tmp_path_factory):
    v = [0.5, -0.25, 1.0]
    rows = [(50, v, 1), (50, v, 1), (50, v, 2), (7, [-x for x in v], 1), (8, v, 2), (8, [0.4, -0.2, 0.8], 2), (100, [-1.0, 0.0, 0.0], 3), (101, [1.0, 0.0, 0.0], 3), (102, v, 4)]
    df = stored(spark, tmp_path_factory, [(*r, 1, 2, 3) for r in rows], SCHEMA, 1)
    assert found(H.hard_negatives(df)) == slow(rows)


def test_bitmap_shrinks_before_all_dimensions_are_read():
    """Rows far from the anchor leave it early, and what stays is right."""
    r = np.random.RandomState(1)
    near, far = r.randint(-20, 20, (50, 64)), r.randint(-20, 20, (5000, 64))
    x = np.concatenate([near + 100, far - 100]).astype(np.float32)
    x[:, 32:] = r.randint(-2, 2, (5050, 32))
    block = H.Block(np.arange(5050), np.arange(5050), np.zeros(5050, np.int64), x)
    seen = []
    scan = H.Scan(block, x[0])

    def needed(least, most):
        keep = most >= H.kth(least, 6)
        seen.append(int(keep.sum()))
        return keep

    at, score = scan.run([(0, 5050)], needed)
    assert seen[0] >= seen[3] >= seen[-1] and seen[4] < 100
    exact = block.columns.T @ x[0]
    assert (score == exact[at]).all() and set(np.argsort(-exact)[:5]) <= set(at.tolist())


def test_exact_types():
    big = np.array([[1 << 20, 3]])
    assert H.exact_type(np.array([[256, -256]]), np.array([[256, 1]])) is np.float32
    assert H.exact_type(big, big) is np.float64
    assert H.exact_type(big * 4096, big) is np.int64
    with pytest.raises(ValueError):
        H.exact_type(big * (1 << 25), big * 4)


def test_against_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    got = queries.op12_hard_negatives(spark, sf_dir)
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({queries.ORACLES['op12_hard_negatives']})").fetchall()
    assert found(got) == sorted(want) and want
