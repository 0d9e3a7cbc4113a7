"""Queries with results known by hand, over the smallest tables, beside their SQL."""

import duckdb
import pytest

from veilspark import golden, golden_files, golden_tables  # noqa: F401

BOTH = golden.Q | golden_tables.Q
SQL = golden.SQL | golden_tables.SQL


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in ("nation", "region", "customer", "supplier", "part", "orders"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(BOTH))
def test_results(spark, sf, con, name):
    got = BOTH[name](spark, sf)
    want = con.execute(SQL[name])
    cols = [d[0] for d in want.description]
    assert sorted(cols) == sorted(got.columns)
    text = lambda rows: sorted(tuple(map(str, r)) for r in rows)
    assert text([r[c] for c in cols] for r in got.collect()) == text(want.fetchall())


def test_cases_are_the_same_everywhere():
    from veilspark.cases import cases

    assert cases() == cases() and len(cases()) == 258 and all(m in t for _, t, must, _ in cases() for m in must)
