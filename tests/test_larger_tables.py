"""Queries against their SQL over rows that only larger tables have."""

import duckdb
import pytest

from provenant.plans import catalog, reports  # noqa: F401  (it registers its queries)

PAGES = "page_id long, url string, html string"


@pytest.fixture
def over(spark, tmp_path):
    """Compare a query with its SQL over tables of these rows; gives the rows."""

    def run(name, **tables):
        con = duckdb.connect()
        for table, (data, schema) in tables.items():
            spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{table}.parquet")
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
        want = con.execute(catalog.ORACLE[name])
        columns = [c[0] for c in want.description]
        found = sorted((tuple(r[c] for c in columns) for r in catalog.QUERIES[name](spark, str(tmp_path)).collect()), key=repr)
        assert found == sorted(want.fetchall(), key=repr)
        return found

    return run


def test_pages_of_one_address_have_survivors_of_their_own(over):
    address = "https://a.example.org/en/1#top"
    found = over("merge_survivors", pages=([(k, address if k < 9 else f"https://a.example.org/{k}", "x") for k in range(1, 40)], PAGES))
    assert {ok for _, corrected, ok in found if corrected == address} == {True, False}


def test_pages_of_few_different_chunks_keep_their_verdict(over):
    """Hardly anything but the end of such a page tells its chunks apart, and it is the end that the reads differ in."""
    found = over("verify_states", pages=([(k, f"https://a.example.org/{k}", html) for k, html in ((153, "x" * 700), (441, "y" * 3000), (30, "z" * 700))], PAGES))
    assert [verdict for _, verdict, *_ in found] == ["stable_unchanged", "unchanged", "stable_unchanged"]
