"""Every query with SQL returns what DuckDB returns for it."""

import math
import os

import duckdb
import pytest
from spectrafield.plans import catalog

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
TABLES = "region nation customer supplier part orders lineitem events embeddings".split()


def canonical(columns, rows):
    """Rows by their exact columns, then by numbers; NaN counts as missing."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    clean = lambda v: None if isinstance(v, float) and math.isnan(v) else v
    rows = [[clean(r[i]) for i in order] for r in rows]
    key = lambda r: ([str(v) for v in r if not isinstance(v, float)], [round(v, 6) for v in r if isinstance(v, float)])
    return [columns[i] for i in order], sorted(rows, key=key)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_matches_sql(spark, duck, name):
    sql = catalog.oracle_sql().get(name)
    df = catalog.queries()[name](spark, DATA)
    got = canonical(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        assert got[0]
        return
    cur = duck.execute(sql)
    want = canonical([c[0] for c in cur.description], cur.fetchall())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])

    def same(a, b):
        if isinstance(a, float) or isinstance(b, float):
            return a is not None and b is not None and math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)
        return a == b or str(a) == str(b)

    bad = [(a, b) for a, b in zip(got[1], want[1]) if not all(map(same, a, b))]
    assert not bad, bad[:2]
