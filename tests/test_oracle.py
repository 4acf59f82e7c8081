"""Every grid query against its SQL, and no Python in the plans."""

import duckdb
import pytest

from geocell import queries as grid

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return a == pytest.approx(b, rel=1e-12, abs=1e-12)
    return a == b


@pytest.mark.parametrize("name", list(grid.QUERIES))
def test_query(spark, duck, name):
    df = grid.QUERIES[name](spark, SF)
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
    rows = df.collect()
    if name not in grid.ORACLE:
        return
    want = duck.sql(grid.ORACLE[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    got = sorted((tuple(r[c] for c in columns) for r in rows), key=repr)
    at = [want.columns.index(c) for c in columns]
    expected = sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=repr)
    assert len(got) == len(expected)
    assert all(same(x, y) for a, b in zip(got, expected, strict=True) for x, y in zip(a, b, strict=True))
