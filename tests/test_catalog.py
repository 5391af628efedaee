"""Every registered query of the citation operators against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from provenant.plans import catalog, jobs, reports, streams  # noqa: F401  (they register their queries)

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    if name not in catalog.ORACLE:
        assert got
        return
    cur = duck.execute(catalog.ORACLE[name])
    names = [d[0] for d in cur.description]
    want = sorted((tuple(dict(zip(names, r, strict=True))[c] for c in columns) for r in cur.fetchall()), key=repr)
    assert sorted(names) == columns and len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert all(x == pytest.approx(y) if isinstance(y, float) else x == y for x, y in zip(a, b, strict=True)), (a, b)
