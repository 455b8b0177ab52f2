"""Each registered query against its SQL, on the smallest tables."""

import math

import duckdb
import pytest

from glyphframe.queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return round(float(v), 4) + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, small, duck, name):
    got = QUERIES[name](spark, small)
    want = duck.execute(ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    key = lambda r: tuple((v is not None, str(type(v)), v) for v in r)
    a = sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=key)
    b = sorted((tuple(plain(v) for v in r) for r in want.fetchall()), key=key)
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert all(p == q or isinstance(p, float) and abs(p - q) < 2e-4 * max(1, abs(p)) for p, q in zip(x, y, strict=True)), (x, y)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, small, name):
    assert QUERIES[name](spark, small).limit(5).count() > 0
