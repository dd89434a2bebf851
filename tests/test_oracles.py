"""Every registered query with SQL against DuckDB on the smallest tables."""

import math

import pytest

duckdb = pytest.importorskip("duckdb")

from tertulia.plans import registry  # noqa: E402

registry.load_all()
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SPARK_TYPES = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "int": "INTEGER"}


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def tidy(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return v


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_rows(spark, con, sf_dir, name):
    df = registry.QUERIES[name](spark, sf_dir)
    cur = con.execute(registry.ORACLES[name])
    heads = [d[0] for d in cur.description]
    cols = sorted(heads)
    assert cols == sorted(df.columns)
    kinds = {d[0]: str(d[1]) for d in cur.description}
    assert {c: SPARK_TYPES.get(t, t) for c, t in df.dtypes} == kinds
    want = sorted((tuple(tidy(r[heads.index(c)]) for c in cols) for r in cur.fetchall()), key=repr)
    got = sorted((tuple(tidy(r[c]) for c in cols) for r in df.collect()), key=repr)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES) - {"e02_logistic", "e03_boosted_trees", "e04_random_forest", "e05_perceptron"}))
def test_rows_only(spark, sf_dir, name):
    df = registry.QUERIES[name](spark, sf_dir)
    assert df.columns and len(df.collect()) > 0
